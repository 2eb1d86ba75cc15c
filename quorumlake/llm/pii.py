"""Personal data by candidates and boosted trees, in DataFrame functions only.

Spans of four kinds are found by fixed patterns with checks (the base). Beside these, wide generators propose spans that
may overlap: numbers in any grouping, and mail and network addresses in guarded spellings. Each candidate is described
by its form and its context and scored by gradient-boosted trees, one model a kind, as plain column expressions. A
candidate over its kind's threshold is added unless it overlaps a base span or a better candidate.

The trees are fitted on texts made from templates (``examples`` of them, fixed seed), so a fit is bounded and the same
on every run; the thresholds are the lowest that reach ``precision`` on texts that the trees haven't seen.

Defined results: a null text counts as empty and has no spans; offsets count code points and ends are exclusive;
repeated rows agree; an empty table gives no rows; further columns are carried through, and those of the operator's own
names are replaced. Patterns never give up characters once taken, so that very long texts cost time in proportion.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OWN = ("base", "added", "base_spans", "spans", "n_email", "n_ip", "n_card", "n_phone")
LOCAL = "A-Za-z0-9._%+-"
# The base patterns. A match begins where a run of its characters does, or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
SPAN = "array<struct<start:int,end:int,kind:int,score:double>>"
CONTEXT = 24


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once."""
    return F.transform(F.array(value), use)[0]


def chunked(a: Column) -> Column:
    """An array that isn't empty as about the square root of its length of pieces, in order."""
    width = F.ceil(F.sqrt(F.size(a))).cast("int")
    return bound(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / w).cast("int")), lambda c: F.slice(a, c * w + 1, w)))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For an array of integers all partial results in order, merge being a sum or a maximum over 0. Arrays are copied as they grow, so this goes by pieces and then over the pieces' results: about n ** 1.5 steps."""
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    scan = lambda piece: F.aggregate(piece, none, lambda acc, x: F.concat(acc, F.array(merge(last(acc), x))))

    def of(v: Column) -> Column:
        def over(pieces: Column) -> Column:
            before = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(merge(last(acc), last(p)))))
            return F.flatten(F.zip_with(pieces, F.slice(before, 1, F.size(pieces)), lambda p, z: F.transform(p, lambda x: merge(z, x))))

        return F.when(F.size(v) > 0, bound(F.transform(chunked(v), scan), over)).otherwise(none)

    return bound(values, of)


def found(text: Column, pattern: str) -> Column:
    """(start, end, found, before) of all matches: the parts between them give the places. before holds up to CONTEXT characters that precede a match; those of four matches with what lies between are enough for it, as matches have six characters or more where it is used."""

    def of(b: Column) -> Column:
        gap = lambda i: F.get(b["gaps"], i)
        ends = running(F.transform(b["hits"], lambda h, i: F.length(gap(i)) + F.length(h)), lambda x, y: x + y)
        tails = F.transform(b["hits"], lambda h, i: F.substring(F.concat(F.coalesce(F.get(b["hits"], i - 1), F.lit("")), gap(i)), -CONTEXT, CONTEXT))

        def spans(t: Column) -> Column:
            before = lambda i: F.substring(F.concat(*[F.coalesce(F.get(t["tails"], i - j), F.lit("")) for j in (3, 2, 1, 0)]), -CONTEXT, CONTEXT)
            return F.transform(b["hits"], lambda h, i: F.struct((F.get(t["ends"], i) - F.length(h)).alias("start"), F.get(t["ends"], i).alias("end"), h.alias("found"), before(i).alias("before")))

        return bound(F.struct(ends.alias("ends"), tails.alias("tails")), spans)

    return bound(F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), of)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    parts = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def ip_parts_fit(x: Column) -> Column:
    return x.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?(?:\.|$)){4}$")


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": ip_parts_fit,
    "card": lambda x: F.length(digits(x)).between(12, 19) & luhn(digits(x)),
    "phone": lambda x: F.length(digits(x)).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    n = KINDS.index(kind)
    hit = F.filter(found(text, PATTERNS[kind]), lambda s: CHECKS[kind](s["found"]))
    spans = F.transform(hit, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(n).alias("kind"), F.lit(math.inf).alias("score")))
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, spans).otherwise(F.array().cast(SPAN))


# Generators of candidates, each with the kinds that it may stand for, and its hint.
GENERATORS = {
    "number": (r"(?<![\w.@=/-])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}+(?![\w@])", ("card", "phone"), r"[0-9](?:[ ().\-/]{0,2}[0-9]){6}"),
    "run": (r"(?<![\w.@=])[0-9]{12,19}+(?![\w@])", ("card",), r"[0-9]{12}"),
    "address": (rf"(?<![{LOCAL}])[A-Za-z0-9._%+-]{{1,64}}+ ?(?:@|[(\[](?i:at)[)\]]) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[(\[](?i:dot)[)\]]) ?[A-Za-z0-9-]{{2,63}}+){{1,5}}+", ("email",), r"(?i)[(\[](?:at|dot)[)\]]"),
    "network": (r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|[(]\.[)])[0-9]{1,3}){3}+(?![0-9.])", ("ip",), r"[0-9][\[(]\.[\])][0-9]"),
}
# Words that speak for a kind shortly before a span.
CUES = {"card": "card|visa|credit|debit|payment|pan|tarjeta|karte|carte", "phone": "phone|tel|call|mobile|cell|fax|contact|whatsapp|telefon|teléfono|téléphone", "ip": "ip|addr|host|server|client|login", "email": "mail|contact|write|reach|e-mail|correo"}
AGAINST = "isbn|order|invoice|version|date|serial|item|part|no\\.|ref|page|total|price|id"

FEATURES = ("n_digits", "n_marks", "n_groups", "longest_group", "plus", "bracket", "dots", "slashes", "spaces", "dashes", "luhn", "parts_fit", "guarded", "cue_card", "cue_phone", "cue_ip", "cue_email", "against", "zero_first", "leading_one", "card_prefix")


def features(x: Column, before: Column) -> dict[str, Column]:
    """Form and context of a candidate as small integers."""
    flag = lambda c: c.cast("int")
    number = digits(x)
    groups = F.filter(F.split(x, "[^0-9]+"), lambda g: g != "")
    low = F.lower(before)
    return {
        "n_digits": F.length(number),
        "n_marks": F.length(x) - F.length(number),
        "n_groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "plus": flag(x.startswith("+")),
        "bracket": flag(x.rlike(r"\([0-9]{2,4}\)")),
        "dots": F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))),
        "slashes": F.length(x) - F.length(F.replace(x, F.lit("/"), F.lit(""))),
        "spaces": F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))),
        "dashes": F.length(x) - F.length(F.replace(x, F.lit("-"), F.lit(""))),
        "luhn": flag(luhn(number) & (F.length(number) >= 12)),
        "parts_fit": flag(ip_parts_fit(F.regexp_replace(x, r"[\[\]()]", ""))),
        "guarded": flag(x.rlike(r"(?i)[\[(](?:at|dot|\.)[\])]")),
        **{f"cue_{k}": flag(low.rlike(rf"(?<![\p{{L}}0-9])(?:{CUES[k]})")) for k in ("card", "phone", "ip", "email")},
        "against": flag(low.rlike(rf"(?<![\p{{L}}0-9])(?:{AGAINST})[\s#:.]")),
        "zero_first": flag(number.startswith("0")),
        "leading_one": flag(number.startswith("1")),
        "card_prefix": flag(number.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
    }


# ---- boosted trees -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Depth two: a feature and a bound, and below each side another, with four values at the ends."""

    root: tuple[int, float]
    sides: tuple[tuple[int, float], tuple[int, float]]
    values: tuple[float, float, float, float]

    def score(self, row: list[float]) -> float:
        side = int(row[self.root[0]] > self.root[1])
        f, bound = self.sides[side]
        return self.values[2 * side + int(row[f] > bound)]

    def column(self, fields: list[Column]) -> Column:
        side = [F.when(fields[f] > bound, self.values[2 * s + 1]).otherwise(self.values[2 * s]) for s, (f, bound) in enumerate(self.sides)]
        return F.when(fields[self.root[0]] > self.root[1], side[1]).otherwise(side[0])


@dataclass
class Model:
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    threshold: float = math.inf

    def score(self, row: list[float]) -> float:
        return self.start + sum(t.score(row) for t in self.trees)

    def column(self, fields: list[Column]) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.column(fields)
        return out


def _best_split(rows: list[list[float]], grad: list[float], hess: list[float], of: list[int], bounds: list[list[float]]) -> tuple[int, float]:
    total_g, total_h = sum(grad[i] for i in of), sum(hess[i] for i in of)
    best = (0.0, 0, math.inf)
    for f, cuts in enumerate(bounds):
        for cut in cuts:
            g = h = 0.0
            for i in of:
                if rows[i][f] > cut:
                    g, h = g + grad[i], h + hess[i]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best[1:]


def boost(rows: list[list[float]], labels: list[int], rounds: int = 12, rate: float = 0.5) -> Model:
    """Logistic gradient boosting with trees of depth two, by second-order gains. Equal rows are one weighted row."""
    grouped: dict[tuple, list[int]] = {}
    for r, y in zip(rows, labels, strict=True):
        n = grouped.setdefault(tuple(r), [0, 0])
        n[y] += 1
    rows, counts = [list(r) for r in grouped], list(grouped.values())
    positive, total = sum(c[1] for c in counts), sum(map(sum, counts))
    if not positive or positive == total:
        return Model()
    bounds = []
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        bounds.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)][:16])
    model = Model(math.log(positive / (total - positive)))
    margin = [model.start] * len(rows)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [c[1] - sum(c) * q for c, q in zip(counts, p, strict=True)]
        hess = [sum(c) * q * (1 - q) for c, q in zip(counts, p, strict=True)]
        root = _best_split(rows, grad, hess, list(range(len(rows))), bounds)
        parts = [[i for i, r in enumerate(rows) if (r[root[0]] > root[1]) == bool(side)] for side in (0, 1)]
        sides = tuple(_best_split(rows, grad, hess, part, bounds) for part in parts)
        values = []
        for part, (f, cut) in zip(parts, sides, strict=True):
            for side in (0, 1):
                own = [i for i in part if (rows[i][f] > cut) == bool(side)]
                values.append(rate * sum(grad[i] for i in own) / (sum(hess[i] for i in own) + 1))
        model.trees.append(tree := Tree(root, sides, tuple(values)))
        margin = [m + tree.score(r) for m, r in zip(margin, rows, strict=True)]
    return model


def calibrate(model: Model, rows: list[list[float]], labels: list[int], precision: float) -> Model:
    """Sets the lowest threshold that reaches the precision on these rows; none does so without a positive row."""
    scored = sorted(((model.score(r), y) for r, y in zip(rows, labels, strict=True)), reverse=True)
    hits = 0
    for n, (score, y) in enumerate(scored, 1):
        hits += y
        if hits >= precision * n and hits and (n == len(scored) or scored[n][0] < score):
            model.threshold = score - 1e-9
    return model


def _card(rng: random.Random, good: bool) -> str:
    body = [int(c) for c in rng.choice(("4", "51", "37", "6011"))]
    body += [rng.randrange(10) for _ in range(15 - len(body))]
    check = -sum(v if i % 2 else (2 * v - 9 * (v > 4)) for i, v in enumerate(reversed(body))) % 10
    return "".join(map(str, [*body, check if good else (check + rng.randrange(1, 10)) % 10]))


def example(rng: random.Random) -> tuple[str, str, str]:
    """(text before, span, kind or "") from templates."""
    d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    words = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 8))) for _ in range(rng.randrange(2, 6)))
    cue = lambda k: f"{words} {rng.choice(CUES[k].split('|'))}: " if rng.random() < 0.6 else f"{words} "
    no = f"{words} {rng.choice(['isbn', 'order', 'invoice', 'version', 'serial', 'ref'])} " if rng.random() < 0.6 else f"{words} "
    octets = [str(rng.randrange(256)) for _ in range(4)]
    pick = rng.randrange(12)
    if pick == 0:
        return cue("phone"), rng.choice((f"({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}")), "phone"
    if pick == 1:
        return f"{words} {rng.choice(CUES['phone'].split('|'))}: ", rng.choice((f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(7)}", f"{d(3)} {d(3)} {d(4)}")), "phone"
    if pick == 2:
        c = _card(rng, True)
        return cue("card"), rng.choice(("/", ".", "  ")).join((c[:4], c[4:8], c[8:12], c[12:])), "card"
    if pick == 3:
        c = _card(rng, False)
        return cue("card") if rng.random() < 0.3 else no, rng.choice((c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}")), ""
    if pick == 4:
        return no, rng.choice((f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", d(10), d(13), d(8), f"{d(2)}/{d(2)}/{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(4)}-{d(4)}", f"{d(4)}/{d(4)}/{d(3)}")), ""
    if pick == 5:
        return f"{words} ", rng.choice((d(7), d(9), f"{d(3)} {d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(5)}-{d(5)}", f"{d(4)}.{d(4)}.{d(4)}")), ""
    if pick in (6, 7):
        return cue("ip"), rng.choice(("[.]", "(.)")).join(octets), "ip"
    if pick == 8:
        return no, "[.]".join([*octets[:3], str(rng.randrange(256, 999))]), ""
    if pick in (9, 10):
        name, host = ("".join(rng.choices("abcdefghij", k=6)) for _ in range(2))
        return cue("email"), rng.choice((f"{name} [at] {host}.com", f"{name}(at){host}(dot)org", f"{name} (at) {host} (dot) net", f"{name}@{host}[dot]com")), "email"
    return no, f"{rng.randrange(99)} (at) {d(2)}.{d(2)}", ""


def fit(spark: SparkSession, examples: int = 2400, precision: float = 0.98, seed: int = 7) -> dict[str, Model]:
    """One calibrated model a kind. Features come from the same expressions as in the operator."""
    rng = random.Random(seed)
    made = [example(rng) for _ in range(examples)]
    values = features(F.col("span"), F.substring(F.col("before"), -CONTEXT, CONTEXT))
    rows = spark.createDataFrame(made, "before string, span string, kind string").coalesce(1).select("kind", F.array(*[values[f].cast("double") for f in FEATURES]).alias("x")).collect()
    out = {}
    for kind in KINDS:
        own = [(r["x"], int(r["kind"] == kind)) for r in rows]
        learn, check = own[: len(own) * 2 // 3], own[len(own) * 2 // 3 :]
        out[kind] = calibrate(boost([x for x, _ in learn], [y for _, y in learn]), [x for x, _ in check], [y for _, y in check], precision)
    return out


# ---- the operator --------------------------------------------------------------------------------------------------


def _scored(text: Column, name: str, models: dict[str, Model]) -> Column:
    """The generator's candidates over a threshold."""
    pattern, kinds, hint = GENERATORS[name]

    def of(s: Column) -> Column:
        made = features(s["found"], s["before"])
        x = F.struct(*[made[f].alias(f) for f in FEATURES])
        return bound(x, lambda v: F.array(*[F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(k)).alias("kind"), (models[k].column([v[f] for f in FEATURES]) - models[k].threshold).alias("score")) for k in kinds]))

    hits = F.filter(F.flatten(F.transform(found(text, pattern), of)), lambda c: c["score"] >= 0)
    return F.when(text.rlike(hint), hits).otherwise(F.array().cast(SPAN))


def spans_of(spans: Column) -> Column:
    """kind:start:end, by start and then by kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def overlaps(s: Column, t: Column) -> Column:
    return (s["start"] < t["end"]) & (t["start"] < s["end"])


def clusters(spans: Column) -> Column:
    """Sorted spans as arrays of such as overlap, directly or through others, in one sweep."""

    def of(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        begins = bound(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(r, i - 1))))
        cut = bound(begins, lambda b: F.transform(b, lambda at, j: F.slice(s, at + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - at)))
        return F.when(F.size(s) > 0, cut).otherwise(F.array().cast(f"array<{SPAN}>"))

    return bound(F.array_sort(spans), of)


def chosen(spans: Column) -> Column:
    """Of base spans and candidates the candidates that stay: those that overlap no base span and, of the others, no better one. Only spans of one cluster are compared."""
    better = lambda d, c: (d["score"] > c["score"]) | ((d["score"] == c["score"]) & ((d["start"] < c["start"]) | ((d["start"] == c["start"]) & (d["kind"] < c["kind"]))))

    def of(c: Column) -> Column:
        is_base = lambda x: x["score"] == math.inf
        free = F.filter(c, lambda x: ~is_base(x) & ~F.exists(c, lambda d: is_base(d) & overlaps(x, d)))
        return F.when(F.size(c) == 1, F.filter(c, lambda x: ~is_base(x))).otherwise(bound(free, lambda f: F.filter(f, lambda x: ~F.exists(f, lambda d: overlaps(x, d) & better(d, x)))))

    return F.flatten(F.transform(clusters(spans), of))


def _located(docs: DataFrame, models: dict[str, Model] | None) -> DataFrame:
    """own_row (the document), own_text, base and added."""
    models = fit(docs.sparkSession) if models is None else models
    own = F.col("own_text")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row"))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    some = F.contains(own, F.lit("@")) | own.rlike(r"[0-9](?:[ ().\-/\[\]+]{0,3}[0-9]){3}") | own.rlike(r"(?i)[(\[](?:at|dot)[)\]]") | own.rlike(HINTS["phone"])
    either = lambda parts: F.when(some, F.concat(*parts)).otherwise(F.array().cast(SPAN))
    held = rows.withColumns({"own_base": either([base_spans(own, k) for k in KINDS]), "own_candidates": either([_scored(own, g, models) for g in GENERATORS])})
    added = F.when(F.size("own_candidates") > 0, chosen(F.concat("own_base", "own_candidates"))).otherwise(F.array().cast(SPAN))
    return held.withColumns({"base": bare("own_base"), "added": bare(added)}).drop("own_base", "own_candidates")


def detect(docs: DataFrame, models: dict[str, Model] | None = None) -> DataFrame:
    """The documents with base (array of spans), added (likewise, from the trees), n_email, n_ip, n_card, n_phone of the base, base_spans and spans."""
    made = (
        _located(docs, models)
        .withColumns({f"n_{k}": F.size(_of_kind(F.col("base"), n)).cast("long") for n, k in enumerate(KINDS)})
        .withColumns({"base_spans": spans_of(F.col("base")), "spans": spans_of(F.concat("base", "added"))})
    )
    return made.select(*[F.col("own_row")[c].alias(c) for c in docs.columns if c not in OWN], *OWN)


def redact(docs: DataFrame, models: dict[str, Model] | None = None) -> DataFrame:
    """The documents with each span of the text, overlapping ones taken together, replaced by its first kind in square brackets. Null texts stay null."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.col("own_text")
    whole = F.transform(clusters(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(0.0).alias("score")))), lambda c: F.struct(c[0]["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), c[0]["kind"].alias("kind")))

    def assembled(w: Column) -> Column:
        """The parts are cut from pieces of the text, as a cut walks from the beginning of what it is made in."""
        items = F.transform(w, lambda x, i: F.struct(F.coalesce(F.get(w, i - 1)["end"], F.lit(0)).alias("from"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

        def piece(c: Column) -> Column:
            begin = c[0]["from"]
            part = F.substring(text, begin + 1, F.element_at(c, -1)["end"] - begin)
            return bound(part, lambda t: F.array_join(F.transform(c, lambda x: F.concat(F.substring(t, x["from"] - begin + 1, x["start"] - x["from"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))), ""))

        return F.concat(F.array_join(bound(items, lambda i: F.transform(chunked(i), piece)), ""), F.substring(text, F.element_at(w, -1)["end"] + 1, F.length(text)))

    cut = F.when(F.size("base") + F.size("added") > 0, bound(whole, assembled)).otherwise(F.col("own_row")["text"])
    return _located(docs, models).withColumn("own_cut", cut).select(*[(F.col("own_cut") if c == "text" else F.col("own_row")[c]).alias(c) for c in docs.columns])
