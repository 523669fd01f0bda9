"""Operator 13 [native]: personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and a naive Bayes classifier of spans is trained on the resulting probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import spool, unspool


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: the pattern of its base spans, what a text with one must match, and what a match must meet.

    Patterns give the contract's matches in linear time: a run is entered at its start only (or where the match before
    ended), and what needs no way back keeps none.
    """

    name: str
    pattern: str
    needs: str
    holds: Callable[[Column], Column]


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _octets(span: Column) -> Column:
    return F.regexp_like(span, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}"))


def _luhn(span: Column) -> Column:
    size = F.length(_digits(span))
    return F.when((size >= 12) & (size <= 19), F.call_function("luhn_check", _digits(span))).otherwise(False)


#: The base kinds, in order.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda s: F.lit(True)),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _octets),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9]", _luhn),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda s: F.length(_digits(s)).between(9, 15)),
]
PLACES = {k.name: n for n, k in enumerate(KINDS)}
#: Candidates, the first that fits at a place: addresses, also spelled out; international numbers; dotted quads; card
#: numbers whole or in groups; national numbers in groups; other runs of digits.
CANDIDATE = "|".join([
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@| ?[(\[] ?(?:at|AT) ?[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[] ?(?:dot|DOT) ?[)\]] ?)[A-Za-z0-9-]++)++",
    r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ -][0-9]{1,4}(?![0-9])){1,5}|\+[0-9]{9,15}(?![0-9])",
    r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{12,19})(?![0-9])",
    r"(?<![0-9])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}(?![0-9])){1,4}",
    r"(?<![0-9])[0-9]{7,11}(?![0-9])",
])
CANDIDATE_NEEDS = r"[0-9]|@|[(\[] ?(?:at|AT) ?[)\]]"
#: Code points of context before and after a candidate, which end at the candidates beside it.
BEFORE, AFTER = 24, 8

#: Gazetteers of top-level domains, calling codes, card issuers and addresses that name nobody.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|me|eu|de|fr|es|it|nl|be|at|ch|pt|pl|se|no|fi|dk|uk|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|ru"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|6[45]|3[0568]|35"
NOBODY = r"0\.|127\.|22[4-9]\.|2[3-5][0-9]\.|[0-9]\.[0-9]\.[0-9]\.[0-9]$"
#: Context words that announce a kind, and those that announce another number.
ANNOUNCED = {
    "email": "e-?mails?|mail|contact|write to|address|courriel|correo|adresse|kontakt",
    "ip": "ip|host|server|client|address|addr|from|ping|serveur|servidor|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|account|carte|tarjeta|karte|kreditkarte|konto",
    "phone": "phone|telephone|tel|call|mobile|cell|fax|contact|number|t[ée]l[ée]phone|appeler|tel[ée]fono|llamar|telefon|rufen",
}
OTHERWISE = "version|v|licen[cs]e|isbn|issn|token|secret|password|passwd|key|hash|sha|md5|build|release|page|section|chapter|article|rfc|order|invoice|ticket|id"


def _vote(yes: Column | None, no: Column | None = None) -> Column:
    """1 for, 0 against, null without an opinion."""
    if yes is None:
        return F.when(no, 0)
    return F.when(yes, 1) if no is None else F.when(yes, 1).when(no, 0)


def _by_kind(**votes: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for kind, vote in votes.items():
        out = out.when(F.col("kind") == kind, vote)
    return out


def _like(name: str, pattern: str) -> Column:
    return F.regexp_like(F.col(name), F.lit(pattern))


def labelers() -> dict[str, Column]:
    """The votes on a candidate (kind, span, digits, before, after, in_base)."""
    size, plus = F.length("digits"), F.startswith(F.col("span"), F.lit("+"))
    domain = _like("span", r"(?i)(?:\.|\]|\)) ?(?:" + DOMAINS + ")$")
    inside = _like("before", r"[\p{L}0-9_]$") | _like("after", r"^[\p{L}0-9_]")
    return {
        "form": _by_kind(
            email=_vote(_like("span", "[.)\\] ][A-Za-z]{2,}$"), ~_like("span", "[.)\\] ][A-Za-z]{2,}$")),
            ip=_vote(_octets(F.col("span")), ~_octets(F.col("span"))),
            card=_vote(_luhn(F.col("span")), ~_luhn(F.col("span"))),
            phone=_vote(plus & size.between(9, 15), ~plus & ~_like("span", "[^0-9]")),
        ),
        "base": _vote(F.col("in_base")),
        "gazetteer": _by_kind(
            email=_vote(domain, ~domain),
            ip=_vote(~_like("span", f"^(?:{NOBODY})"), _like("span", f"^(?:{NOBODY})")),
            card=_vote(_like("digits", f"^(?:{ISSUERS})"), ~_like("digits", f"^(?:{ISSUERS})")),
            phone=_vote(plus & _like("digits", f"^(?:{CALLING})"), plus & ~_like("digits", f"^(?:{CALLING})")),
        ),
        "announced": _by_kind(**{k: _vote(_like("before", rf"(?i)(?<!\p{{L}})(?:{words})[^\p{{L}}]*$")) for k, words in ANNOUNCED.items()}),
        "otherwise": _vote(None, _like("before", rf"(?i)(?<!\p{{L}})(?:{OTHERWISE})[^\p{{L}}]*$")),
        "apart": _vote(~inside, inside),
        "plain": _vote(None, _like("digits", "^([0-9])\\1*$|^0?1234567")),
    }


def features() -> dict[str, Column]:
    """What the classifier sees besides the votes: small whole numbers."""
    size = F.length("digits")
    first = lambda name, *patterns: F.coalesce(*[F.when(_like(name, p), n) for n, p in enumerate(patterns)], F.lit(len(patterns)))
    return {
        "size": F.when(F.col("kind") == "email", 0).when(size < 9, 1).when(size < 12, 2).when(size < 15, 3).when(size < 17, 4).otherwise(5),
        "marks": first("span", "[(\\[]", "@", "\\+", "\\.", "-", " ", "/"),
        "left": first("before", "^$|\\s$", "[\\p{L}]$", "[0-9_]$", "[\"'=]$"),
        "right": first("after", "^$|^\\s", "^[\\p{L}]", "^[0-9_]", "^[\"'=]", "^[.,;:!?)]"),
    }


#: Matches of a text are summed in blocks of this size.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _starts(rows: Column) -> Column:
    """Where each match (gap, own) starts: running sums of lengths, of whole blocks first and then inside each block."""

    def sums(sizes: Column, start: Column) -> Column:
        """start, and the sum with each of the sizes."""
        return F.aggregate(sizes, F.array(start), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def inside(part: Column, start: Column) -> Column:
        sizes = F.transform(part, lambda x: x["gap"] + x["own"])
        return F.zip_with(part, F.slice(sums(sizes, start), F.lit(1), F.size(part)), lambda x, at: at + x["gap"])

    def over(parts: Column) -> Column:
        whole = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x["gap"] + x["own"]))
        return F.flatten(F.zip_with(parts, sums(whole, F.lit(0)), inside))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
    return _let(blocks, over)


def _matches(text: Column, pattern: str, needs: str, give: Callable[[Column, Column, Column, Column], Column], kind: str) -> Column:
    """array<kind> of give(start, span, gap before, gap after) for every match, nulls left out; empty where the text does
    not match `needs`. Matches and the stretches between them alternate, so positions are sums of their lengths."""
    length = lambda x: F.length(x).cast("int")

    def of(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return _let(gaps, lambda g: _let(F.zip_with(found, F.slice(g, F.lit(1), F.size(found)), lambda m, x: F.struct(length(x).alias("gap"), length(m).alias("own"))), lambda rows: given(found, g, rows)))

    def given(found: Column, gaps: Column, rows: Column) -> Column:
        sides = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)), lambda a, b: F.struct(F.right(a, F.lit(BEFORE)).alias("before"), F.left(b, F.lit(AFTER)).alias("after")))
        placed = F.zip_with(found, _starts(rows), lambda m, at: F.struct(m.alias("span"), at.alias("start")))
        return F.array_compact(F.zip_with(placed, sides, lambda p, s: give(p["start"], p["span"], s["before"], s["after"])))

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    empty = F.array().cast(f"array<{kind}>")
    return F.when(F.regexp_like(text, F.lit(needs)), _let(found, lambda m: F.when(F.size(m) > 0, of(m)).otherwise(empty))).otherwise(empty)


SPAN = "struct<start:int,place:int,kind:string,end:int>"
_CANDIDATE = "struct<start:int,end:int,span:string,before:string,after:string>"


def base_spans(text: Column) -> Column:
    """array<struct<start, place, kind, end>> of the base kinds, by start, then by kind: code points, end exclusive."""

    def spans(place: int, kind: Kind) -> Column:
        def give(start: Column, span: Column, before: Column, after: Column) -> Column:
            whole = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"), (start + F.length(span)).cast("int").alias("end"))
            return F.when(kind.holds(span), whole)

        return _matches(text, kind.pattern, kind.needs, give, SPAN)

    return F.array_sort(F.concat(*[spans(n, k) for n, k in enumerate(KINDS)]))


def candidate_spans(text: Column) -> Column:
    """array<struct<start, end, span, before, after>> of what the labelers vote on."""

    def give(start: Column, span: Column, before: Column, after: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(span)).cast("int").alias("end"), span.alias("span"), before.alias("before"), after.alias("after"))

    return _matches(text, CANDIDATE, CANDIDATE_NEEDS, give, _CANDIDATE)


def _voted(found: DataFrame) -> DataFrame:
    """(key, start, end, kind, in_base, votes, seen): the candidates with their votes as a string of 0, 1 and -, and what
    the classifier sees as an array."""
    rows = found.select("key", F.explode("candidates").alias("c")).select("key", "c.*", F.lit(False).alias("base"))
    base = found.where(F.size("candidates") > 0).select("key", F.explode("base").alias("b")).select("key", "b.start", "b.end", *[F.lit(None).cast("string").alias(c) for c in ("span", "before", "after")], F.lit(True).alias("base"))
    near = Window.partitionBy("key").orderBy("start", "end")
    until = F.max(F.when(F.col("base"), F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    since = F.min(F.when(F.col("base"), F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    inside = F.coalesce(until > F.col("start"), F.lit(False)) | F.coalesce(since < F.col("end"), F.lit(False))
    marked = rows.unionByName(base).withColumn("in_base", inside).where("NOT base").withColumn("digits", _digits(F.col("span")))
    size = F.length("digits")
    kind = (
        F.when(_like("span", "@|[(\\[] ?(?:at|AT)"), "email").when(_like("span", "^\\+"), F.when(size.between(7, 15), "phone"))
        .when(_like("span", "^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$"), "ip").when(size.between(12, 19), "card").when(size.between(7, 11), "phone")
    )
    votes = F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in labelers().values()])
    named = marked.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("votes", votes)
    seen = F.array(*[F.substring("votes", n + 1, 1) for n in range(len(labelers()))], *[x.cast("string") for x in features().values()])
    return named.select("key", "start", "end", "kind", "in_base", "votes", seen.alias("seen"))


def estimate(patterns: list[tuple[str, int]], rounds: int = 30) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """The probability that a candidate of each vote pattern is personal data, and each labeler's rate of votes for true and
    votes against false candidates, by expectation-maximisation over (votes, count).

    Votes are taken as independent given the truth. Rates start from eight votes in ten right, and keep four such votes
    and one wrong as a prior; a pattern starts from the share of its votes that are for it.
    """
    p = {v: (1 + v.count("1")) / (2 + v.count("0") + v.count("1")) for v, _ in patterns}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds if patterns else 0):
        total = sum(n for _, n in patterns)
        share = (1 + sum(n * p[v] for v, n in patterns)) / (2 + total)
        rates = []
        for j in range(len(patterns[0][0])):
            right = sum(n * p[v] for v, n in patterns if v[j] == "1")
            true = sum(n * p[v] for v, n in patterns if v[j] != "-")
            wrong = sum(n * (1 - p[v]) for v, n in patterns if v[j] == "0")
            false = sum(n * (1 - p[v]) for v, n in patterns if v[j] != "-")
            rates.append(((4 + right) / (5 + true), (4 + wrong) / (5 + false)))
        for v, _ in patterns:
            odds = math.log(share / (1 - share))
            for x, (a, b) in zip(v, rates):
                odds += math.log(a / (1 - b)) if x == "1" else math.log((1 - a) / b) if x == "0" else 0.0
            p[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return p, rates


def _classifier(sums: list[tuple[str, int, str, float, float]]) -> tuple[dict[str, float], dict[tuple[str, int, str], float]]:
    """Log odds of a kind, and what each value of each thing seen adds to them, from sums of probabilities for and against
    (kind, place, value, for, against). A value adds nothing that was never seen."""
    of_place: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
    for kind, place, value, yes, no in sums:
        of_place.setdefault((kind, place), []).append((value, yes, no))
    prior, adds = {}, {}
    for (kind, place), values in of_place.items():
        yes, no = sum(x[1] for x in values), sum(x[2] for x in values)
        prior[kind] = math.log((yes + 1) / (no + 1))
        for value, a, b in values:
            adds[kind, place, value] = math.log((a + 1) / (yes + len(values))) - math.log((b + 1) / (no + len(values)))
    return prior, adds


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found) of every row: array<struct<start, place, kind, end>> of the base spans, and of all spans.

    All spans are the base ones and the candidates that the classifier takes and that overlap none of them. Texts are
    read once and never shuffled: what is moved are candidates. The driver sees counts of vote patterns, at most 3^7 a
    kind, and sums per value of what the classifier sees. Matches are leftmost and do not overlap. Null texts are empty;
    repeated rows stay repeated, each a document of its own, in the counts too; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found, _ = spool(rows.select("id", F.monotonically_increasing_id().alias("key"), base_spans(text).alias("base"), candidate_spans(text).alias("candidates")), "personal")
    voted, voted_path = spool(_voted(found), "votes")
    patterns: dict[str, list[tuple[str, int]]] = {}
    for r in voted.groupBy("kind", "votes").count().collect():
        patterns.setdefault(r["kind"], []).append((r["votes"], r["count"]))
    truth = [(kind, v, p) for kind, counts in patterns.items() for v, p in estimate(sorted(counts))[0].items()]
    known = spark.createDataFrame(truth, "kind string, votes string, p double")
    seen = voted.join(F.broadcast(known), ["kind", "votes"]).select("kind", "p", F.posexplode("seen").alias("place", "value"))
    sums = seen.groupBy("kind", "place", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    prior, adds = _classifier([tuple(r) for r in sums])
    score = F.lit(0.0)
    for place in [-1, *range(len(labelers()) + len(features()))]:
        table = {k: x for k, x in prior.items()} if place < 0 else {k + v: x for (k, at, v), x in adds.items() if at == place}
        key = F.col("kind") if place < 0 else F.concat("kind", F.col("seen")[place])
        if table:
            score += F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key), F.lit(0.0))
    place = F.element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), F.col("kind"))
    span = F.struct("start", place.alias("place"), "kind", "end")
    added = voted.where(~F.col("in_base") & (score > 0)).groupBy("key").agg(F.collect_list(span).alias("added"))
    taken, _ = spool(added, "added")
    unspool(spark, voted_path)
    empty = F.array().cast(f"array<{SPAN}>")
    return found.join(taken, "key", "left").select("id", "base", F.array_sort(F.concat("base", F.coalesce("added", empty))).alias("found"))
