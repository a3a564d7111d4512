"""Personal data by weak supervision, in DataFrame operations only.

Base spans (kept in any case) are leftmost non-overlapping matches of one pattern for each kind that pass the kind's test.
The method adds spans: a looser pattern for each kind gives candidates in the text beside the kind's base spans. Labelers vote
on every match, base or loose, with 1 (personal), -1 (not) or 0 (no say): a strict pattern, a checksum or format test, a gazetteer
(top-level domains, country codes, card issuers, address ranges), words before or after that speak for the kind, words
before that speak against it, and clean borders. Expectation-maximisation over the table of vote patterns (at most a
few thousand rows, however large the corpus) estimates for each kind how often it is true and how reliable each labeler is,
without labels. A logistic span classifier over votes and shape is then trained on the posteriors, and compiled into one
expression that accepts candidates. Base matches teach every kind its labelers, also where loose candidates are few.

Time is in proportion to the text: patterns start at the beginning of a run only, positions and context come from the pieces
between matches by running sums in blocks of ``BLOCK``, and no fold gathers a list of matches. Every step is an
expression over one row; nothing but the vote table is shuffled.

Defined results: null text counts as empty; spans of different kinds may overlap; positions count code points, ends
are exclusive; context is what stands between a match and the matches next to it. Columns of docs keep their names, but those
that are added (base_<kind>, span_<kind>) are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans. A match can only begin where a run of its first characters does, or where the last match ended (\G): the
#: same matches, but no run is tried from each of its characters. Possessive where that changes nothing but the depth of the search.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of the candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![\p{L}0-9])(?:[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}|3[47][0-9]{2}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}|[0-9]{16})(?![\p{L}0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![0-9+(.-])\(?[0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+(.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]++(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]++)++$",
    "ip": r"^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$|:",
    "card": r"^[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}$|^3[47][0-9]{2}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}$",
    "phone": r"^\+[0-9]{1,3}\x20?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}$|^\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$",
}
#: Gazetteers of well-known beginnings and endings.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|eu|us|nl|ch|at|be|pl|pt|ca|au|jp|cn|in|br|mx)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: Words near a span that speak for its kind, and words right before one that speak against all kinds.
SPEAKS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client|from|adresse|dirección)\b",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta|konto)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp)\b",
}
AGAINST = r"(?i)(?:\b(?:version|v|section|chapter|isbn|issn|doi|order|invoice|build|release|token|id|no|nr|figure|fig|table)\b[.:#=\x20\"]*|[=#/\"])$"
LABELERS = ("strict", "check", "gazetteer", "context", "against", "border")
ROUNDS = 30
_SPAN = "struct<start:int,end:int,found:string>"
_VOTED = "struct<start:int,end:int,found:string,base:boolean," + "".join(f"{n}:int," for n in LABELERS) + "shape:string>"


def _of(kind: str, f):
    """f for one kind, as a function of a span alone."""
    return lambda s: f(kind, s)


# --- positions and tests ----------------------------------------------------------------------------------------------

#: Items of one block of a running sum.
BLOCK = 64


def once(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _blocks(xs: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.floor(F.size(xs) / F.lit(BLOCK)).cast("int")), lambda b: b * BLOCK < F.size(xs))


def _own(b: Column, xs: Column) -> Column:
    """The items of block b of an array (a slice would copy the whole array first)."""
    return F.transform(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(xs)) - 1), lambda i: F.get(xs, i))


def running(values: Column, op) -> Column:
    """For each of some whole numbers, op (a sum or a maximum, from 0 on) over all before it.

    A fold copies its state in every step, so that a fold that gathers an array takes n * n steps. Here folds hold numbers only: blocks
    are summed, the few sums are gathered, and inside a block the short rest is summed for each item.
    """

    def over(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, first, lambda a, x: op(a, x))

    def gathered(sums: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def run(xs: Column) -> Column:
        sums = F.transform(_blocks(xs), lambda b: over(_own(b, xs), F.lit(0)))
        inside = lambda own, first: F.transform(own, lambda _, k: over(F.slice(own, F.lit(1), k), first))
        return once(gathered(sums), lambda offsets: F.flatten(F.transform(_blocks(xs), lambda b: once(_own(b, xs), lambda own: inside(own, F.get(offsets, b))))))

    return once(values, run)


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<found, between>>: the text before each match of a pattern, and the match; found is null in the last one."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.arrays_zip(found.alias("found"), between.alias("between"))


def find(parts: Column) -> Column:
    """The matches of pieces as array<struct<start, end, found>>; matches are never empty."""
    sizes = F.transform(parts, lambda x: F.length(x["between"]) + F.coalesce(F.length(x["found"]), F.lit(0)))

    def span(at: Column, i: Column) -> Column:
        start = at + F.length(F.get(parts, i)["between"])
        return F.struct(start.alias("start"), (start + F.length(F.get(parts, i)["found"])).alias("end"), F.get(parts, i)["found"].alias("found"))

    return F.filter(F.transform(running(sizes, lambda a, x: a + x), span), lambda s: s["found"].isNotNull())


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits of a string pass the Luhn checksum."""
    each = F.transform(F.split(F.reverse(_digits(found)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The test of a kind's base matches."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & luhn(found)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _guard(kind: str, loose: bool, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    if kind == "email":
        return (text.contains("(at)") | text.contains("[at]") | text.contains("(AT)") | text.contains("[AT]")) if loose else text.contains("@")
    if kind == "phone" and not loose:
        return text.contains("+")
    return F.col("_digit")


@dataclass(frozen=True)
class Names:
    """Columns of the steps in between, by names that docs does not have."""

    text: str
    digit: str
    base: dict[str, str]
    loose: dict[str, str]


def _names(docs: DataFrame) -> Names:
    return Names(fresh(docs, "text"), fresh(docs, "digit"), {k: fresh(docs, f"pieces_{k}") for k in KINDS}, {k: fresh(docs, f"loose_{k}") for k in KINDS})


def _guard(kind: str, loose: bool, names: Names) -> Column:
    """A cheap test that no text with a match fails."""
    text = F.col(names.text)
    if kind == "email":
        return (text.contains("(at)") | text.contains("[at]") | text.contains("(AT)") | text.contains("[AT]")) if loose else text.contains("@")
    if kind == "phone" and not loose:
        return text.contains("+")
    return F.col(names.digit)


def base_spans(docs: DataFrame, text: str = "text", names: Names | None = None) -> DataFrame:
    """docs with base_<kind>: array<struct<start, end, found>> for each kind."""
    own = names or _names(docs)
    out = docs.withColumn(own.text, F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(own.digit, F.col(own.text).rlike("[0-9]"))
    out = out.withColumns({own.base[k]: F.when(_guard(k, False, own), pieces(F.col(own.text), BASE[k])) for k in KINDS})
    spans = lambda k: F.filter(find(F.col(own.base[k])), _of(k, lambda k, s: valid(k, s["found"])))
    out = out.withColumns({f"base_{k}": F.when(F.size(own.base[k]) > 1, spans(k)).otherwise(F.array().cast(f"array<{_SPAN}>")) for k in KINDS})
    return out if names else out.drop(own.text, own.digit, *own.base.values())


def candidates(docs: DataFrame, names: Names) -> DataFrame:
    """base_spans with loose_<kind>: candidates beside the kind's base spans, and base matches (base = true), with votes and shape."""
    out = docs
    for k in KINDS:
        # base spans are blanked out, sign for sign, before the looser pattern is sought
        blank = F.array_join(F.transform(F.col(names.base[k]), _of(k, lambda k, x: F.concat(x["between"], F.when(x["found"].isNull(), F.lit("")).when(valid(k, x["found"]), F.repeat(F.lit("\x01"), F.length(x["found"]))).otherwise(x["found"])))), "")
        beside = F.when(F.size(f"base_{k}") > 0, blank).otherwise(F.col(names.text))
        out = out.withColumn(names.loose[k], F.when(_guard(k, True, names), pieces(beside, LOOSE[k])))
    return out.withColumns({names.loose[k]: F.concat(_judged(k, names.loose[k], False), _judged(k, names.base[k], True)) for k in KINDS})


def _judged(kind: str, parts: str, base: bool) -> Column:
    """The matches of pieces with votes: array<struct<start, end, found, base, votes, shape>>."""
    p = F.col(parts)
    at = find(p)
    near = F.transform(at, lambda s, i: F.struct(s.alias("span"), F.right(F.get(p, i)["between"], F.lit(40)).alias("before"), F.left(F.get(p, i + 1)["between"], F.lit(24)).alias("after")))
    if not base and kind != "email":
        near = F.filter(near, lambda x: _check(kind, x["span"]["found"]))  # what fails its test is no candidate
    if base and kind == "card":
        near = F.filter(near, lambda x: F.length(_digits(x["span"]["found"])).between(13, 19))  # any other number is no card
    judged = F.transform(near, lambda x: _voted(kind, x["span"]["start"], x["span"]["found"], x["before"], x["after"], base))
    return F.when(F.size(p) > 1, judged).otherwise(F.array().cast(f"array<{_VOTED}>"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0))


def _check(kind: str, found: Column) -> Column:
    """Checksum or format test of a candidate; numbers that fail it are no candidates at all."""
    if kind == "card":
        return luhn(found)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "ip":
        return F.when(found.contains(":"), F.lit(True)).otherwise(valid("ip", found))
    return found.rlike(r"(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z]{2,}+$")


def _voted(kind: str, start: Column, found: Column, before: Column, after: Column, base: bool) -> Column:
    digits = F.length(_digits(found))
    check = _check(kind, found)
    votes = {
        "strict": _vote(found.rlike(STRICT[kind]), ~found.rlike(STRICT[kind])),
        "check": _vote(check, ~check),
        "gazetteer": _vote(found.rlike(GAZETTEER[kind]), ~found.rlike(GAZETTEER[kind])),
        "context": _vote(before.rlike(SPEAKS[kind]) | after.rlike(SPEAKS[kind])),
        "against": _vote(F.lit(False), F.rtrim(before).rlike(AGAINST)),
        "border": _vote(~before.rlike(r"[\p{L}\p{N}_.]$") & ~after.rlike(r"^[\p{L}\p{N}_]"), before.rlike(r"[\p{L}\p{N}_.]$") | after.rlike(r"^[\p{L}\p{N}_]")),
    }
    shape = F.concat(F.least(digits, F.lit(20)).cast("string"), F.when(found.rlike(r"[\x20().-]"), F.lit("s")).otherwise(F.lit("")), F.when(found.startswith("+"), F.lit("+")).otherwise(F.lit("")))
    return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), F.lit(base).alias("base"), *[v.cast("int").alias(n) for n, v in votes.items()], shape.alias("shape"))


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier: bias by kind, weight by (kind, labeler, vote) and by (kind, shape); and the posteriors' parameters."""

    bias: dict[str, float] = field(default_factory=dict)
    votes: dict[tuple[str, str, int], float] = field(default_factory=dict)
    shapes: dict[tuple[str, str], float] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Prior and posterior of each vote pattern (votes, count), with labelers independent given the truth.

    Each labeler has its own table P(vote | truth). The start is the share of positive votes, and pseudo-counts keep a
    labeler that is right four times in five in mind, so that few candidates cannot turn a labeler around.
    """
    total = sum(n for _, n in patterns) or 1.0
    q = [0.2 + 0.6 * (sum(v == 1 for v in votes) / max(1, sum(v != 0 for v in votes))) for votes, _ in patterns]
    prior = 0.5
    kinds = len(patterns[0][0]) if patterns else 0
    for _ in range(rounds):
        prior = (sum(p * n for p, (_, n) in zip(q, patterns, strict=True)) + 1.0) / (total + 2.0)
        tables = []
        for i in range(kinds):
            table = {}
            for truth in (0, 1):
                held = {-1: 0.8 if not truth else 0.2, 0: 1.0, 1: 0.8 if truth else 0.2}
                weight = {v: 4.0 * held[v] for v in held}
                for p, (votes, n) in zip(q, patterns, strict=True):
                    weight[votes[i]] += n * (p if truth else 1 - p)
                whole = sum(weight.values())
                for v, x in weight.items():
                    table[v, truth] = x / whole
            tables.append(table)
        q = []
        for votes, _ in patterns:
            up = math.log(prior) - math.log(1 - prior) + sum(math.log(tables[i][v, 1] / tables[i][v, 0]) for i, v in enumerate(votes))
            q.append(1 / (1 + math.exp(-max(-40.0, min(40.0, up)))))
    return prior, q


def train(rows: list[tuple[str, tuple[int, ...], str, float]]) -> Model:
    """The span classifier from the table (kind, votes, shape, count)."""
    model = Model()
    for kind in KINDS:
        own = sorted((votes, shape, n) for k, votes, shape, n in rows if k == kind)
        if not own:
            continue
        by: dict[tuple[int, ...], float] = {}
        for votes, _, n in own:
            by[votes] = by.get(votes, 0.0) + n
        patterns = sorted(by.items())
        prior, posterior = expectation_maximisation(patterns)
        soft = dict(zip([v for v, _ in patterns], posterior, strict=True))
        names = [("", "", 0), *sorted({("vote", LABELERS[i], v) for votes, _, _ in own for i, v in enumerate(votes)}), *sorted({("shape", shape, 0) for _, shape, _ in own})]
        place = {x: i for i, x in enumerate(names)}
        uses = [[0, *[place["vote", LABELERS[i], v] for i, v in enumerate(votes)], place["shape", shape, 0]] for votes, shape, _ in own]
        w, total = [0.0] * len(names), sum(n for *_, n in own)
        for _ in range(400):
            g = [0.002 * x for x in w]
            for (votes, _, n), use in zip(own, uses, strict=True):
                z = sum(w[i] for i in use)
                e = (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - soft[votes]) * n / total
                for i in use:
                    g[i] += e
            w = [x - 1.0 * y for x, y in zip(w, g, strict=True)]
        model.bias[kind], model.prior[kind] = w[0], prior
        for (what, name, v), x in zip(names[1:], w[1:], strict=True):
            if what == "vote":
                model.votes[kind, name, v] = x
            else:
                model.shapes[kind, name] = x
    return model


def fit(docs: DataFrame) -> Model:
    """Votes of all candidates of docs, counted in Spark by pattern; EM and classifier over the counts."""
    docs = docs.select("text")
    names = _names(docs)
    rows = candidates(base_spans(docs, names=names), names)
    each = rows.select(F.explode(F.flatten(F.array(*[F.transform(names.loose[k], _of(k, lambda k, s: F.struct(F.lit(k).alias("kind"), *[s[n].alias(n) for n in LABELERS], s["shape"].alias("shape")))) for k in KINDS]))).alias("s")).select("s.*")
    table = each.groupBy("kind", *LABELERS, "shape").agg(F.count(F.lit(1)).alias("n")).collect()
    return train([(r["kind"], tuple(r[n] for n in LABELERS), r["shape"], float(r["n"])) for r in table])


def _accepts(model: Model, kind: str, s: Column) -> Column:
    score = F.lit(model.bias[kind])
    for name in LABELERS:
        vote = F.lit(0.0)
        for v in (-1, 0, 1):
            vote = F.when(s[name] == v, F.lit(model.votes.get((kind, name, v), 0.0))).otherwise(vote)
        score = score + vote
    shape = F.lit(0.0)
    for (k, x), w in sorted(model.shapes.items()):
        if k == kind:
            shape = F.when(s["shape"] == x, F.lit(w)).otherwise(shape)
    return score + shape >= 0


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """docs with base_<kind> and span_<kind> (base spans and accepted candidates, by start) for each kind."""
    names = _names(docs)
    rows = candidates(base_spans(docs, names=names), names)
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))
    out = {}
    for k in KINDS:
        if k in model.bias:
            added = F.transform(F.filter(names.loose[k], _of(k, lambda k, s: ~s["base"] & _accepts(model, k, s))), plain)
            out[f"span_{k}"] = F.when(F.size(names.loose[k]) == 0, F.col(f"base_{k}")).otherwise(F.sort_array(F.concat(F.col(f"base_{k}"), added)))
        else:
            out[f"span_{k}"] = F.col(f"base_{k}")
    return rows.withColumns(out).drop(names.text, names.digit, *names.base.values(), *names.loose.values())


def listing(prefix: str) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""
    return F.array_join(F.flatten(F.array(*[F.transform(f"{prefix}_{k}", _of(k, lambda k, s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))) for k in KINDS])), ",")


def masked(text: Column) -> Column:
    """The text with every span of span_<kind> replaced by <KIND>; spans that overlap are one place with the mark of the first to start (then of the longest)."""
    every = F.sort_array(F.flatten(F.array(*[F.transform(f"span_{k}", _of(k, lambda k, s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"<{k.upper()}>").alias("mark")))) for k in KINDS])))

    def united(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: -s["back"]), F.greatest)  # where the spans before each one end
        placed = F.transform(reach, lambda end, i: F.struct(F.get(spans, i)["start"].alias("start"), end.alias("before"), F.get(spans, i)["mark"].alias("mark")))
        heads = F.filter(placed, lambda s, i: (i == 0) | (s["start"] >= s["before"]))
        last = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, -s["back"]))
        return once(heads, lambda h: F.transform(h, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(h, i + 1)["before"], last).alias("end"), s["mark"].alias("mark"))))

    return F.when(F.size(every) == 0, text).otherwise(once(once(every, united), lambda told: _replaced(text, told)))


def _replaced(text: Column, told: Column) -> Column:
    """The text with non-overlapping spans (start, end, mark) in order replaced by their marks.

    A place in a text is found by counting from its beginning; so the text is cut into blocks of spans first, and these into spans.
    """

    def block(b: Column) -> Column:
        low = F.when(b == 0, F.lit(0)).otherwise(F.get(told, b * BLOCK - 1)["end"])
        high = F.get(told, F.least((b + 1) * BLOCK, F.size(told)) - 1)["end"]
        whole = F.struct(F.substring(text, low + 1, high - low).alias("text"), low.alias("low"), _own(b, told).alias("own"))

        def put(w: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                after = F.when(i == 0, w["low"]).otherwise(F.get(w["own"], i - 1)["end"])
                return F.concat(F.substring(w["text"], after - w["low"] + 1, s["start"] - after), s["mark"])

            return F.array_join(F.transform(w["own"], one), "")

        return once(whole, put)

    body = F.array_join(F.transform(_blocks(told), block), "")
    return F.concat(body, F.substring(text, F.get(told, F.size(told) - 1)["end"] + 1, F.length(text)))
