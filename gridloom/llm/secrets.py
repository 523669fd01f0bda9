"""Operator 6 [native]: secret scans behind an inverted index of trigrams.

Each rule's pattern is read into a Boolean query of trigrams. The texts' postings of the trigrams that the queries name
become a table (gram, key); a query is answered by joining its trigrams to the postings and keeping the keys that hold all
of a choice. Texts of these keys are verified with the pattern itself; rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._constants as kind_of
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import spool, unspool


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern (valid in Java and Python alike) and the least code points of a group of the match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The patterns and limits of the base kinds. The runs of access and hex are greedy and whole, so their
#: limits stand in the pattern; those of assign are checked after the match, for a failing match takes its text along.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
]
#: Public formats of further credentials.
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
#: The most strings that a stretch of a pattern is spelled out into.
SPELLED = 256


def _spelled(op, arg) -> set[str] | None:
    """All strings that one element of a pattern can match, lower-cased; None if they are many or unbounded."""
    if op is kind_of.LITERAL:
        return {chr(arg).lower()}
    if op is kind_of.IN:
        out: set[str] = set()
        for what, x in arg:
            if what is kind_of.LITERAL:
                out.add(chr(x).lower())
            elif what is kind_of.RANGE and x[1] - x[0] < SPELLED:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is kind_of.SUBPATTERN:
        return _all(arg[3])
    if op is kind_of.BRANCH:
        parts = [_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (kind_of.MAX_REPEAT, kind_of.MIN_REPEAT):
        low, high, inner = arg
        once = _all(inner)
        if once is None or high > 3:
            return None
        return {"".join(x) for n in range(low, high + 1) for x in product(once, repeat=n)}
    return {""} if op is kind_of.AT else None


def _all(elements) -> set[str] | None:
    out = {""}
    for op, arg in elements:
        more = _spelled(op, arg)
        if more is None or len(out) * len(more) > SPELLED:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams (of lower-cased text) of which every text with a match holds one whole; None: it can lack any.

    The pattern is read as a sequence of stretches with finitely many spellings; a stretch whose spellings all have
    three characters or more asks for the trigrams of one of them. All stretches are mandatory, so the query is the
    product of their choices, from which sets that hold another one drop out.
    """
    choices: list[set[frozenset[str]]] = []
    stretch = {""}

    def close() -> None:
        if min(map(len, stretch)) >= 3:
            choices.append({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in stretch})

    for op, arg in parser.parse(pattern):
        more = _spelled(op, arg)
        if more is None or len(stretch) * len(more) > SPELLED:
            close()
            stretch = more or {""}
        else:
            stretch = {a + b for a in stretch for b in more}
    close()
    if not choices:
        return None
    sets = {frozenset().union(*x) for x in product(*choices)}
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key) once for each text (key, text) that holds the trigram, in either case."""
    held = _let(F.lower("text"), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams])))
    # outer, as a filter on the array would compute it once more
    return texts.select("key", held.alias("held")).select(F.explode_outer("held").alias("gram"), "key").where("gram IS NOT NULL").distinct()


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, places): the places of the rules whose query the text's postings satisfy.

    A query is a choice of sets of trigrams; a key answers it that stands in the posting lists of all of one set. The
    queries are a table of constant size; postings meet it by trigram and are counted per key, rule and choice.
    """
    spark = index.sparkSession
    wanted = [(place, n, gram, len(choice)) for place, query in queries.items() for n, choice in enumerate(query) for gram in sorted(choice)]
    asked = spark.createDataFrame(wanted, "place int, choice int, gram string, need int")
    held = index.join(F.broadcast(asked), "gram").groupBy("key", "place", "choice", "need").agg(F.count("*").alias("held"))
    return held.where("held = need").groupBy("key").agg(F.collect_set("place").alias("places"))


_SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"
#: Matches of a text are summed in blocks of this size.
BLOCK = 256


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of a rule's matches: code points, end exclusive.

    Matches and the stretches between them alternate, so positions are running sums of their lengths: of whole blocks
    first, then inside each block from where it starts, which stays near linear for texts with very many matches.
    """
    pattern = F.lit(rule.pattern)
    length = lambda x: F.length(x).cast("int")
    found = F.regexp_extract_all(text, pattern, 0)
    checked = F.regexp_extract_all(text, pattern, rule.group) if rule.group else None

    def pairs(found: Column) -> Column:
        rows = F.zip_with(found, F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(length(gap).alias("gap"), length(m).alias("own")))
        if checked is None:
            return F.transform(rows, lambda x: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), (x["own"] >= rule.least).alias("ok")))
        return F.zip_with(rows, checked, lambda x, c: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), (F.length(c) >= rule.least).alias("ok")))

    def inside(rows: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["gap"]
            span = F.struct(first.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (first + x["own"]).alias("end"))
            return F.struct((first + x["own"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, F.struct(start.alias("at"), F.array().cast(_SPANS).alias("out")), add, lambda acc: acc["out"])

    def in_blocks(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
        return _let(blocks, lambda parts: F.flatten(F.zip_with(parts, starts(parts), inside)))

    def starts(parts: Column) -> Column:
        sizes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda rows: F.aggregate(rows, F.lit(0), lambda n, x: n + x["gap"] + x["own"]))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    return F.when(F.size(found) > 0, _let(_let(found, pairs), in_blocks))


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) of every row: found is array<struct<start, place, kind, end>> of all rules, by start, then by rule.

    Texts have the hash of id and text as their key in the index; equal keys are harmless, as candidates are verified.
    Matches of a rule are leftmost and do not overlap. Null texts are empty; repeated rows stay repeated; an empty table
    gives an empty result.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    queries = {place: q for place, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not None}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    if queries:
        index, path = spool(postings(rows, sorted({g for q in queries.values() for s in q for g in s})), "postings")
        answers, _ = spool(candidates(index, queries), "candidates")
        unspool(rows.sparkSession, path)
        rows = rows.join(answers, "key", "left")
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<int>"))
    text, empty = F.col("text"), F.array().cast(_SPANS)
    found = [F.when(F.array_contains("places", place), _spans(text, rule, place)) if place in queries else _spans(text, rule, place) for place, rule in enumerate(rules)]
    return rows.select("id", F.array_sort(F.concat(*[F.coalesce(x, empty) for x in found])).alias("found"))


def described(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
