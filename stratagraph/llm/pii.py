"""Personal data by weak supervision, in DataFrame operations only: labelers vote, expectation-maximisation weighs them, a
span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_col

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written with possessive quantifiers: they match the same spans, in linear time and constant stack. A
#: local part or number can't start inside a run of its own characters unless the match before ended there.
_LOCAL = r"A-Za-z0-9._%+\-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20\-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
    # Candidates that only the labelers can tell: written-out addresses and numbers without the plus sign.
    "wide_email": r"(?i)\b[a-z0-9._%+\-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[a-z0-9\-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[a-z0-9\-]{1,63}){1,4}",
    "wide_phone": r"(?<![0-9+(.\-])(?<![0-9] )\(?[0-9]{3}\)?[\x20.\-][0-9]{3}[\x20.\-][0-9]{4}(?![0-9.\-]|\x20[0-9])",
}
#: A cheap test that a text without any match fails.
_NEEDS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "wide_email": lambda t: t.rlike(r"(?i)[\[({]\s?at\s?[\])}]")}
LABELERS = ("pattern", "gazetteer", "context", "border")
_CONTEXT = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|dirección|adresse",
    "card": "card|visa|credit|payment|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|fax|teléfono|téléphone|telefon",
}
_GAZETTEER = {
    "email": r"(?i)(?:\.|\]|\)|\}|dot)\s?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example|test)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23\d\.|1\.1\.1\.1$)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+?(?:1[ .\-]?)?\(?(?!000|999)[0-9]{3}\)?[ .\-][0-9]{3}[ .\-]?[0-9]{4}$|^\+(?:[1-9][0-9]{0,2})[ (.\-]",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.reverse(F.split(digits, "(?<=.)(?=.)")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    d = _digits(m)
    small = lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, F.concat(F.lit("0"), p)).cast("int"), F.lit(999)) <= 255)
    part = F.forall(F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0"))), small)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", part)
        .when(kind == "card", F.length(d).between(12, 19) & luhn(F.when(F.length(d).between(12, 19), d).otherwise("1")))
        .when(kind == "phone", F.length(d).between(9, 15))
        .otherwise(False)
    )


def _matches(rows: DataFrame) -> DataFrame:
    """doc_id, h, pattern, start, end, found, before, after: every match of every pattern, by code points."""
    for name, p in PATTERNS.items():
        hits = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        rows = rows.withColumn(f"hits_{name}", F.when(_NEEDS[name](F.col("text")), hits) if name in _NEEDS else hits)
    one = [
        F.when(F.size(f"hits_{name}") > 0, F.struct(F.lit(name).alias("pattern"), F.col(f"hits_{name}").alias("hits"), F.split("text", p, -1).alias("gaps")))
        for name, p in PATTERNS.items()
    ]
    each = rows.select("doc_id", "h", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("m"))
    each = each.select("doc_id", "h", "m.pattern", F.posexplode(F.transform("m.hits", lambda x, i: F.struct(x.alias("found"), F.length(F.get("m.gaps", i)).alias("gap"), F.right(F.get("m.gaps", i), F.lit(40)).alias("before"), F.left(F.get("m.gaps", i + 1), F.lit(40)).alias("after")))).alias("k", "x"))
    w = Window.partitionBy("doc_id", "h", "pattern").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.length("x.found")).over(w)
    return each.select("doc_id", "h", "pattern", (end - F.length("x.found")).alias("start"), end.alias("end"), "x.found", "x.before", "x.after")


def _votes(spans: DataFrame) -> DataFrame:
    """Votes of 1 (personal data), 0 (not) or -1 (none) by each labeler."""
    kind, found = F.col("kind"), F.col("found")
    by_kind = lambda table, make: F.coalesce(*[F.when(kind == k, make(v)) for k, v in table.items()])
    text = F.lower(F.concat_ws(" ", "before", "after"))
    d = _digits(found)
    return spans.withColumns(
        {
            "pattern_vote": F.col("base").cast("int"),
            "gazetteer_vote": by_kind(_GAZETTEER, lambda p: found.rlike(p)).cast("int"),
            "context_vote": F.when(by_kind(_CONTEXT, lambda p: text.rlike(rf"\b(?:{p})")), 1).otherwise(-1),
            "border_vote": F.when(F.col("before").rlike(r"[\p{L}\p{N}_/#$%]$") | F.col("after").rlike(r"^[\p{L}\p{N}_/]"), 0).otherwise(-1),
            "length": F.when((kind == "card") & F.length(d).isin(15, 16), 1).when((kind == "phone") & F.length(d).isin(10, 11), 1).when(kind.isin("email", "ip"), 1).otherwise(0),
        }
    )


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[float, float]], list[float]]:
    """Expectation-maximisation over counted vote patterns: (prior, [(P(vote 1 | true), P(vote 1 | false))], posteriors).
    An abstention says nothing. Starts from labelers that are right more often than not, which fixes the classes' names."""
    n = len(patterns[0][0]) if patterns else 0
    prior, rate, post = 0.5, [(0.8, 0.2)] * n, [0.5] * len(patterns)
    for _ in range(rounds):
        post = []
        for votes, _count in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for v, (t, f) in zip(votes, rate, strict=True):
                if v >= 0:
                    a, b = a + math.log(t if v else 1 - t), b + math.log(f if v else 1 - f)
            post.append(1 / (1 + math.exp(max(min(b - a, 500), -500))))
        total = sum(c for _, c in patterns)
        prior = min(max((sum(p * c for p, (_, c) in zip(post, patterns, strict=True)) + 1) / (total + 2), 0.01), 0.99) if total else 0.5
        new = []
        for k in range(n):
            said = [(p, v[k], c) for p, (v, c) in zip(post, patterns, strict=True) if v[k] >= 0]
            t = (sum(p * c for p, v, c in said if v) + 4) / (sum(p * c for p, v, c in said) + 5)
            f = (sum((1 - p) * c for p, v, c in said if v) + 1) / (sum((1 - p) * c for p, v, c in said) + 5)
            new.append((min(max(t, 0.01), 0.99), min(max(f, 0.01), 0.99)))
        rate = new
    return prior, rate, post


def _features(kind: str, votes: tuple[int, ...], length: int) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *[float(v == w) for v in votes for w in (0, 1)], float(length)]


def classifier(rows: list[tuple[list[float], float, int]], ridge: float = 1.0, rounds: int = 300) -> list[float]:
    """Logistic regression on soft labels (features, posterior, count) by gradient steps with a step size of 1/L."""
    n = len(rows[0][0]) if rows else 0
    w, total = [0.0] * n, sum(c for _, _, c in rows) or 1
    for _ in range(rounds):
        g = [ridge * x / total for x in w]
        for x, y, c in rows:
            p = 1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(w, x, strict=True)), 30), -30)))
            for k in range(n):
                if x[k]:
                    g[k] += (p - y) * c / total * x[k]
        w = [a - 0.8 * b for a, b in zip(w, g, strict=True)]
    return w


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs.

    Matches of the base patterns that pass their checks are spans. The labelers (base pattern and check, gazetteer of endings,
    issuers and prefixes, words near the span, characters at its border) vote on every match, also on those that fail and on
    written-out addresses and numbers without a plus sign. Expectation-maximisation over the counted vote patterns of each
    kind (at most 3^4 * 2 of them) gives the labelers' reliabilities and posteriors; a logistic span classifier is trained
    on these and adds the matches it gives threshold or more, unless they overlap a base span.

    Offsets are code points, ends exclusive. Null and empty texts have no spans: counts of 0, the digest of no bytes and an
    empty string. Fully equal rows get equal results; other columns are ignored; an empty table gives an empty result. Work
    grows with the number of spans of a text, not with its square.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text")).withColumn("h", F.xxhash64("text"))
    found = _matches(rows)
    found = found.withColumn("kind", F.regexp_replace("pattern", "^wide_", "")).withColumn("base", _valid(F.col("pattern"), F.col("found")))
    # A number of few digits is no candidate at all.
    found = found.where(F.col("base") | ((F.col("kind") != "card") | F.length(_digits(F.col("found"))).between(12, 19))).distinct()
    spans = scratch.write(_votes(found), "spans")
    votes = [f"{x}_vote" for x in LABELERS]
    counted = spans.groupBy("kind", "length", *votes).agg(F.count("*").alias("n")).collect()  # at most 4 * 2 * 3^4 rows
    training = []
    for kind in KINDS:
        mine = [r for r in counted if r["kind"] == kind]
        _, _, post = reliabilities([(tuple(r[v] for v in votes), r["n"]) for r in mine])
        training += [(_features(kind, tuple(r[v] for v in votes), r["length"]), p, r["n"]) for r, p in zip(mine, post, strict=True)]
    w = classifier(training)
    z = F.lit(w[0] if w else -1.0)
    if w:
        terms = [(F.col("kind") == k) for k in KINDS] + [F.col(v) == x for v in votes for x in (0, 1)] + [F.col("length") == 1]
        for t, weight in zip(terms, w[1:], strict=True):
            z = z + F.when(t, float(weight)).otherwise(0.0)
    spans = spans.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("order", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")))
    # A span that the method adds overlaps no base span: none that starts up to its start ends behind it, none starts inside it.
    place = Window.partitionBy("doc_id", "h")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(place.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(place.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    told = spans.where(F.col("base") | (F.col("p") >= threshold)).withColumn("reach", reach).withColumn("ahead", ahead)
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    item = F.struct("start", "order", "end", "kind", "base")
    per = told.where(F.col("base") | free).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(item)).alias("all"))
    per = per.withColumn("own", F.filter("all", lambda x: x["base"]))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("own", lambda x: x["kind"] == k))
    per = per.select(
        F.col("doc_id").alias("i"),
        F.col("h").alias("ih"),
        *[count(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("own"), 256).alias("base_sha256"),
        joined("all").alias("spans"),
    )
    out = rows.select("doc_id", "h").join(per, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("ih")), "left")
    out = out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    return scratch.tied_to(out)


def op9_pii(spark, sf_dir):
    """Every document with its counts of base spans, their digest, and all spans."""
    return find_personal_data(table(spark, sf_dir, "documents"))
