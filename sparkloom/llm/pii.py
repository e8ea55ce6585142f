"""Personal data by weak supervision, in DataFrame expressions only.

Base spans are regex matches.  Their places come from the gaps between matches (``split`` beside
``regexp_extract_all``), so each text is scanned a fixed number of times and no row is exploded.

Beyond them, wider patterns propose candidates: national phone numbers, emails spelled out with (at) and dot,
masked and defanged ips, card numbers inside longer runs of digits.  Six labelers vote on each candidate and each
base span: regex (a stricter pattern of the kind), shape, gazetteer (ends of domains, calling codes, first digits
of cards), context, boundary and checksum (Luhn, octets, labels of domains, digits).  Votes are counted by (kind,
vote pattern), a table of at most 4 x 64 rows; on that table expectation-maximisation estimates each
labeler's hit and false-alarm rate, and a logistic span classifier is trained on the posteriors, with
the votes as its features.  Its weights go back into the plan as an expression: candidates at
0.5 or more that touch no base span are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize
from sparkloom.llm.quality import let

KINDS = ("email", "ip", "card", "phone")
# The base patterns, possessive where nothing could be given back, and only at places
# where a run begins or the last match ended, as a later place in a failed run fails too.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: what a text must contain for a match
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: candidates of the method: spelled-out addresses, masked and defanged ips, cards inside longer runs of digits, national phones
_AT, _DOT = "(?: ?[(\\[](?:at|AT)[)\\]] ?| (?:at|AT) )", "(?:\\.| ?[(\\[](?:dot|DOT)[)\\]] ?| (?:dot|DOT) )"
WIDER = {
    "email": f"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){2}\\.(?:[xX]{1,3}|\\*)(?![0-9A-Za-z.])|(?<![0-9.])[0-9]{1,3}(?:(?:\\[\\.\\]|\\(\\.\\))[0-9]{1,3}){3}(?![0-9])",
    "card": "(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{14,19})(?![0-9])",
    "phone": "(?<![0-9+])(?:\\(?[0-9]{3}[) .-]{1,2}[0-9]{3}[ .-]?[0-9]{4}|0[1-9](?:[ .-]?[0-9]{2}){4}|0[1-9][0-9]{1,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}|00[1-9][0-9 ().-]{7,16}[0-9])(?![0-9])",
}
_WIDER_NEEDS = {"email": ("at)", "at]", "AT)", "AT]", " dot ", " DOT "), "ip": (".x", ".X", ".*", "[.]", "(.)"), "card": None, "phone": None}
LABELERS = ("regex", "shape", "gazetteer", "context", "boundary", "checksum")
# Ends of domains, calling codes and first digits of cards.
_ENDS = "com org net edu gov mil int info biz name pro io co me tv app dev cloud online site shop ai eu de fr es it uk nl be ch at pl se no dk fi ie pt gr cz hu ro ru ua tr il in cn jp kr au nz ca us mx br ar cl za"
_CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STRICT = {
    "email": f"^[A-Za-z0-9][A-Za-z0-9._%+-]*(@[A-Za-z0-9][A-Za-z0-9-]*(\\.[A-Za-z0-9-]+)*?\\.[A-Za-z]{{2,}}|({_AT}|@)[A-Za-z0-9][A-Za-z0-9-]*({_DOT}[A-Za-z0-9-]+)*?{_DOT}({_ENDS.replace(' ', '|')}))$",
    "ip": f"^({_OCTET}(\\.|\\[\\.\\]|\\(\\.\\))){{3}}({_OCTET}|[xX]{{1,3}}|\\*)$",
    "card": "^(4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(011|5[0-9]{2})[0-9]{12})$",
    "phone": "^(\\+[1-9][0-9]{0,2}[ .-]?)?\\(?[2-9][0-9]{2}\\)?[ .-]{0,2}[2-9][0-9]{2}[ .-]?[0-9]{4}$|^(0|00|\\+)[1-9][0-9 ()./-]{7,18}$",
}
_SHAPE = {"email": f"(@|{_AT})[^@]+{_DOT}[A-Za-z]{{2,}}$", "ip": "^([0-9.]{7,15}|[0-9.]{6,12}[xX*]+|[0-9.\\[\\]()]{13,21})$", "card": "^([0-9]{4}([ -]?)[0-9]{4}\\2[0-9]{4}\\2[0-9]{2,7}|[0-9]{4}([ -]?)[0-9]{6}\\3[0-9]{5})$", "phone": "^(\\+[0-9]{1,3} ?)?\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^0[0-9]([ .-][0-9]{2}){4}$|^0[0-9]{2,5}[ /-][0-9 -]+$|^00[0-9 ().-]+$"}
_GAZETTEER = {"email": f"(?i){_DOT}({_ENDS.replace(' ', '|')})$", "ip": "^(?!0[.\\[(]|127[.\\[(]|255[.\\[(])", "card": "^(4|5[1-5]|2[2-7]|3[47]|6011|65)", "phone": f"^(\\+|00)({_CALLING.replace(' ', '|')})|^\\(?[2-9][0-8][0-9]|^0[1-9]"}
_CONTEXT = {"email": "mail|contact|write|reach|schreib|correo|courriel", "ip": "\\bip\\b|host|server|address|addr|login|client", "card": "card|visa|credit|karte|carte|tarjeta|pay", "phone": "phone|call|tel|fax|mobil|cell|ring|whatsapp"}
_BEFORE = 24
#: values of an array that are added up in one go
_STRETCH = 256


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or other merges of whole numbers from 0) of an array: within stretches, then over their ends.

    An array grows by a copy, so stretches of ``_STRETCH`` keep the work near the number of values.
    """
    start = F.expr("cast(named_struct('at', 0, 'out', array()) as struct<at:int,out:array<int>>)")
    step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(merge(acc["at"], x))).alias("out"))
    scan = lambda part: F.aggregate(part, start, step, lambda acc: acc["out"])
    last = lambda whole: F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / _STRETCH).cast("int")
    cut = lambda whole: F.transform(F.sequence(F.lit(0), last(whole)), lambda i: scan(F.slice(whole, i * _STRETCH + 1, F.lit(_STRETCH))))
    ends = lambda parts: scan(F.transform(parts, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0))))
    return let(let(values, cut), lambda parts: let(ends(parts), lambda done: F.flatten(F.transform(parts, lambda x, i: F.transform(x, lambda y: merge(y, F.when(i == 0, 0).otherwise(F.get(done, i - 1))))))))


def _matches(text: Column, pattern: str, need: str | tuple[str, ...] | None) -> Column:
    """array<struct<s,e,m,before,edge>> of all matches: start and end in code points, the text, what stands before
    it (since the match before, lower case) and the characters on its two sides ("0" for another match)."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,before:string,edge:string>>)")

    def placed(m: Column, gap: Column, ends: Column) -> Column:
        left = lambda i: F.when(F.get(gap, i) != "", F.right(F.get(gap, i), F.lit(1))).when(i == 0, " ").otherwise("0")
        right = lambda i: F.when(F.get(gap, i + 1) != "", F.left(F.get(gap, i + 1), F.lit(1))).when(i == F.size(m) - 1, "").otherwise("0")
        return F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("s"), F.get(ends, i).alias("e"), x.alias("m"), F.lower(F.right(F.get(gap, i), F.lit(_BEFORE))).alias("before"), F.concat(left(i), right(i)).alias("edge")))

    def whole(m: Column, gap: Column) -> Column:
        sizes = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gap, i)))
        return let(_running(sizes, lambda a, b: a + b), lambda ends: placed(m, gap, ends))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda gap: whole(m, gap)))
    needs = [need] if isinstance(need, str) else need or ()
    hit = reduce(Column.__or__, [text.contains(x) for x in needs]) if needs else text.rlike(pattern)
    return F.when(hit, found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    nth = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(nth, lambda d: d != ""), value), F.lit(0), lambda t, x: t + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def _base_of(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, PATTERNS[kind], _NEEDS[kind]), lambda x: _valid(kind, x["m"]))


def _voted(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), _votes(kind, x).alias("votes")))


def _votes(kind: str, x: Column) -> Column:
    digits = _digits(x["m"]) if kind == "card" else x["m"]
    # what a number or a name can be checked by alone: Luhn, octets, labels of a domain, digits of a phone
    n = F.length(_digits(x["m"]))
    check = {
        "card": lambda: F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False),
        "ip": lambda: ~x["m"].rlike("(^|[^0-9])(0[0-9]|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])"),
        "email": lambda: ~x["m"].rlike("[.-][.-]|[ .@)\\]]-|-( |\\.|$)|\\.@|^[^A-Za-z]+[ @(\\[]"),
        "phone": lambda: (n >= 10) & (n <= 15) & ~digits.rlike("([0-9])\\1{5}"),
    }[kind]()
    votes = (digits.rlike(_STRICT[kind]), x["m"].rlike(_SHAPE[kind]), digits.rlike(_GAZETTEER[kind]), x["before"].rlike(_CONTEXT[kind]), ~x["edge"].rlike("[0-9A-Za-z_/=]"), check)
    return F.concat(*(F.when(v, "1").otherwise("0") for v in votes))


def _blocks(base: Column) -> Column:
    """array<struct<lo,hi,part>>: spans in order of their starts, in stretches with the least start and the largest end."""
    ends = F.sort_array(F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))
    last = lambda spans: F.floor(F.greatest(F.size(spans) - 1, F.lit(0)) / _STRETCH).cast("int")
    cut = lambda spans: F.transform(F.sequence(F.lit(0), last(spans)), lambda i: F.slice(spans, i * _STRETCH + 1, F.lit(_STRETCH)))
    return let(ends, lambda spans: F.transform(cut(spans), lambda p: F.struct(F.get(p, F.lit(0))["s"].alias("lo"), F.array_max(F.transform(p, lambda b: b["e"])).alias("hi"), p.alias("part"))))


def _apart(x: Column, blocks: Column) -> Column:
    """Whether x touches no base span."""
    met = lambda b: (b["lo"] < x["e"]) & (x["s"] < b["hi"]) & F.exists(b["part"], lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return ~F.coalesce(F.exists(blocks, met), F.lit(False))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, with base and more: array<struct<s,k,e,votes>>; more holds the method's candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({f"__{k}": _base_of(text, k) for k in KINDS})
    rows = rows.withColumn("__blocks", _blocks(F.concat(*(F.col(f"__{k}") for k in KINDS))))
    more = [_voted(k, F.filter(_matches(text, WIDER[k], _WIDER_NEEDS[k]), lambda x: _apart(x, F.col("__blocks")))) for k in WIDER]
    voted = [_voted(k, F.col(f"__{k}")) for k in KINDS]
    return rows.withColumns({"__base": F.concat(*voted), "__more": F.concat(*more)}).drop("__blocks", *(f"__{k}" for k in KINDS))


def fit(rows: DataFrame, rounds: int = 50) -> dict[int, list[float]]:
    """Classifier weights (bias first) by kind, from vote patterns of rows with __base and __more."""
    spans = rows.select(F.explode(F.concat("__base", "__more")).alias("x")).groupBy("x.k", "x.votes").count().orderBy("k", "votes").collect()
    return {k: _train([([int(c) for c in v], n) for kk, v, n in spans if kk == k], rounds) for k in range(len(KINDS))}


def estimate(table: list[tuple[list[int], int]], rounds: int = 50) -> tuple[float, list[float], list[float], list[float]]:
    """EM over vote patterns with counts: (share of true spans, hit rates, false-alarm rates, posterior of each pattern)."""
    m = len(table[0][0]) if table else len(LABELERS)
    hit, false, prior = [0.8] * m, [0.2] * m, 0.5
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for v, _n in table:
            a = math.log(prior) + sum(math.log(h if x else 1 - h) for x, h in zip(v, hit))
            b = math.log(1 - prior) + sum(math.log(f if x else 1 - f) for x, f in zip(v, false))
            post.append(1 / (1 + math.exp(min(700, b - a))))
        yes, no = sum(p * n for p, (_, n) in zip(post, table)), sum((1 - p) * n for p, (_, n) in zip(post, table))
        prior = (yes + 2) / (yes + no + 4)
        # votes count 4 in advance: a labeler is right four times in five
        hit = [(sum(p * n for p, (v, n) in zip(post, table) if v[i]) + 3.2) / (yes + 4) for i in range(m)]
        false = [(sum((1 - p) * n for p, (v, n) in zip(post, table) if v[i]) + 0.8) / (no + 4) for i in range(m)]
    return prior, hit, false, post


def _train(table: list[tuple[list[int], int]], rounds: int) -> list[float]:
    """Logistic regression of EM's posteriors on the votes."""
    post = estimate(table, rounds)[3]
    w, total = [0.0] * (len(table[0][0]) + 1 if table else len(LABELERS) + 1), sum(n for _, n in table) or 1
    for _ in range(400):
        grad = [0.002 * x for x in w]
        for p, (v, n) in zip(post, table):
            z = w[0] + sum(a for a, x in zip(w[1:], v) if x)
            err = (1 / (1 + math.exp(-z)) - p) * n / total
            grad[0] += err
            for i, x in enumerate(v):
                grad[i + 1] += err * x
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def chosen(weights: dict[int, list[float]], base: str = "__base", more: str = "__more") -> Column:
    """Sorted array<struct<s,k,e>> of the base spans and the candidates that the classifier takes."""
    def score(x: Column) -> Column:
        z = F.lit(0.0)
        for k, w in weights.items():
            own = F.lit(w[0])
            for i, a in enumerate(w[1:]):
                own = own + F.when(F.substring(x["votes"], i + 1, 1) == "1", a).otherwise(0.0)
            z = F.when(x["k"] == k, own).otherwise(z)
        return z

    strip = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    return F.sort_array(F.concat(F.transform(base, strip), F.transform(F.filter(more, lambda x: score(x) >= 0), strip)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: sorted array<struct<s,k,e>>, a row per input row; k numbers KINDS, places are code points.

    A null or empty text has no spans.  Null ids, repeated rows and extra columns change nothing.  An
    empty table gives an empty result; without any candidate the base spans are all there is.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    rows = materialize(candidates(src, "__text").drop("__text"))
    strip = F.sort_array(F.transform("__base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return rows.select("doc_id", strip.alias("base"), chosen(fit(rows)).alias("spans"))


def _marked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind; what overlaps an earlier span goes without a mark of its own.

    A text with many spans is taken apart into characters once, so that no place is counted from the text's begin for each span.
    """
    names = F.array(*map(F.lit, KINDS))
    name = lambda x: F.concat(F.lit("<"), F.element_at(names, x["k"] + 1), F.lit(">"))

    def joined(reach: Column, cut: Callable[[Column, Column], Column]) -> Column:
        at = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
        piece = lambda x, i: F.when(x["s"] < at(i), "").otherwise(F.concat(cut(at(i), x["s"] - at(i)), name(x)))
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(F.get(reach, F.size(reach) - 1), F.lit(2**31 - 1)))

    few = lambda reach: joined(reach, lambda at, n: F.substring(text, at + 1, n))
    many = lambda reach: let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda chars: joined(reach, lambda at, n: F.array_join(F.slice(chars, at + 1, F.least(n, F.size(chars))), "")))
    return let(_running(F.transform(spans, lambda x: x["e"]), F.greatest), lambda reach: F.when(F.size(spans) <= 16, few(reach)).otherwise(many(reach)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, n_chars set anew for those rows; columns stay.

    Overlapping spans become one.  Null texts stay null.
    """
    # written once, with the texts: fitting and marking both read the candidates
    rows = materialize(candidates(docs, text_col))
    rows = rows.withColumns({"__spans": chosen(fit(rows)), "__text": F.coalesce(F.col(text_col), F.lit(""))})
    text = F.when(F.size("__spans") > 0, _marked(F.col("__text"), F.col("__spans"))).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.drop("__text", "__base", "__more", "__spans")
