"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of the base patterns (email, ip, card, phone), whether or not they pass their check, and those
of looser patterns: telephone numbers without a plus, cards in dotted groups, mail addresses with a spelt-out sign, and
secrets (long runs of letters and figures: tokens, keys, passwords). Five labelers vote on each candidate, for, against or not
at all: a check of the match (its digits, a spelt-out domain, an assignment before a secret), a gazetteer of top-level domains,
number and key prefixes, the shape, words of the context that speak for the kind, and words that speak against it. Candidates
are counted by kind, origin, votes and features of span and context (a few hundred rows; 5 kinds * 3 origins * 3 ** 5 votes *
SHAPES at most, whatever the corpus). On these counts expectation-maximisation estimates, for each kind, how reliable each
labeler is (Dawid and Skene, 1979), and a logistic span classifier over votes, length, variety of characters, separators and
what stands right before the span is trained on the posteriors. Its accepted patterns go back to the spans as literals. Base
matches that pass their check are always spans; loose candidates become spans if two labelers speak for them, the classifier
accepts them and no base span overlaps; base matches that fail are dropped.

Only the table of counts reaches the driver. Texts are read once; what is found is written to the shared folder.

Null and empty texts have no spans. Offsets are code points, end exclusive. Long texts are read whole: repeated groups in
the patterns are possessive, so they neither overflow the matcher's stack nor take quadratic time. Repeated rows get the
same spans each. An empty table gives an empty result. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# Leftmost matches of the plain patterns in the docstrings of the tests. Possessive groups match the same, as what follows
# each cannot begin inside it; the look-behind skips starts inside a run that has failed as a whole.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINT = {"email": "@", "phone": "+"}
LOOSE = {
    "phone": r"(?<![0-9+(.\-])(?<![0-9]\s)\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_+/.@-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+(?![@.][A-Za-z0-9])",
}

# fixed values: words that speak for a kind, words that speak against any, gazetteers of domains and card prefixes
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach)\b[^\n]{0,20}$",
    "ip": r"(?i)\b(?:ip|host|server|address|from|ping)\b[^\n]{0,20}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|paid)\b[^\n]{0,20}$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|dial)\b[^\n]{0,20}$",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|key|auth|bearer|credential)s?\b\W{0,5}$",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|ref|id|no|page|section|rfc)\b[.:#]?\s{0,2}$"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|int|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|in|jp|cn|br|ru|ch|at|be|se|no|dk|fi|pl|pt|example|test)$"
AGAINST_SECRET = r"(?i)(?:\b(?:sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|etag|id)\b\W{0,5}|https?:\S*)$"
KEYS = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|pk_|AIza|eyJ|glpat-)"
CARDS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IN_RANGE = rf"^0*{BYTE}(?:\.0*{BYTE}){{3}}$"

CONTEXT = 40
LABELERS = ("check", "gazetteer", "shape", "context", "against")
PASSED, LOOSELY, FAILED = 2, 1, 0
#: Features of a span as one number: length (4), variety of characters (3), separators (2), what stands before it (3).
SHAPES = 4 * 3 * 2 * 3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    figures = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(figures, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def checked(kind: str, match: Column) -> Column:
    n = F.char_length(digits(match))
    if kind == "ip":
        return match.rlike(IN_RANGE)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def loosely_checked(kind: str, match: Column, context: Column) -> Column:
    """The check's vote on a match of a looser pattern."""
    number = digits(match)
    if kind == "phone":
        return F.when(number.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), 2).otherwise(1)
    if kind == "card":
        return F.when(luhn(number), 2).otherwise(0)
    if kind == "email":
        return F.when(plain_address(match).rlike(r"^[^@]+@[^@\s]+\.[A-Za-z]{2,}$"), 2).otherwise(1)
    return F.when(context.rlike(r"[=:]\s{0,2}[\"']?$"), 2).otherwise(1)


def plain_address(match: Column) -> Column:
    signs = F.regexp_replace(match, r"(?i) ?(?:\[at\]|\(at\)) ?", "@")
    return F.regexp_replace(signs, r"(?i) ?(?:\[dot\]|\(dot\)) ?| ?\. ?", ".")


def votes(kind: str, origin: Column, match: Column, context: Column) -> Column:
    """The votes as one number, a base-3 digit for each of LABELERS: 0 against, 1 none, 2 for."""
    yes_no = lambda c: F.when(c, 2).otherwise(0)
    number, n = digits(match), F.char_length(digits(match))
    gazetteer = {"email": yes_no(plain_address(match).rlike(DOMAINS)), "ip": F.when(match.rlike(r"^(?:0|255)\."), 0).otherwise(1), "card": yes_no(number.rlike(CARDS)), "phone": F.when(number.rlike("^0*$"), 0).otherwise(1), "secret": F.when(match.rlike(KEYS), 2).otherwise(1)}[kind]
    shape = {"email": yes_no(~match.rlike(r"\.\.|^\.")), "ip": yes_no(match.rlike(IN_RANGE)), "card": yes_no(n.between(13, 16)), "phone": yes_no(n.between(10, 13)), "secret": F.when(match.rlike(r"/|^[A-Za-z]+[0-9]{1,4}$"), 0).when(n >= 4, 2).otherwise(1)}[kind]
    against = AGAINST_SECRET if kind == "secret" else AGAINST
    check = F.when(origin == PASSED, 2).when(origin == FAILED, 0).otherwise(loosely_checked(kind, match, context) if kind in LOOSE else F.lit(1))
    each = [check, gazetteer, shape, F.when(context.rlike(FOR[kind]), 2).otherwise(1), F.when(context.rlike(against), 0).otherwise(1)]
    code = F.lit(0)
    for vote in each:
        code = code * 3 + vote
    return code


def shape_of(match: Column, context: Column) -> Column:
    """The features of span and context, see SHAPES."""
    n, kinds = F.char_length(match), F.size(F.array_distinct(F.split(match, "")))
    length = F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3)
    variety = F.when(kinds < 6, 0).when(kinds < 11, 1).otherwise(2)
    before = F.when(context.rlike(r"[=:]\s{0,2}[\"'(]?$"), 2).when(context.rlike(r"(?:^|\n)\s*$"), 1).otherwise(0)
    return ((length * 3 + variety) * 2 + match.rlike(r"[ .()-]").cast("int")) * 3 + before


def placed(text: Column, pattern: str) -> Column:
    """Array of (begin, end, match, context): offsets from the lengths of the pieces between the matches."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p"))), lambda x: x["m"].isNotNull())
    empty = F.expr("cast(array() as array<struct<begin:int,end:int,match:string,context:string>>)")
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("at"),
            F.concat(s["found"], F.array(F.struct((s["at"] + F.char_length(x["p"])).alias("begin"), (s["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("end"), x["m"].alias("match"), F.right(x["p"], F.lit(CONTEXT)).alias("context")))).alias("found"),
        ),
        lambda s: s["found"],
    )


CANDIDATES = "array<struct<begin:int,kind:int,end:int,origin:int,votes:int,shape:int>>"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, candidates): array of (begin, kind, end, origin, votes, shape)."""
    whole = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    whole = whole.withColumn("figures", F.col("t").rlike("[0-9]{2}|[0-9][ .-][0-9]"))
    whole = whole.withColumn("run", F.col("t").rlike("[A-Za-z0-9_+/-]{20}"))
    whole = whole.withColumn("spelt", F.contains("t", F.lit("[at]")) | F.contains("t", F.lit("(at)")))
    none = F.expr("cast(array() as array<struct<begin:int,end:int,match:string,context:string>>)")
    parts = []
    for kind, pattern in BASE.items():
        # an address of one-figure parts is figures, too: 1.2.3.4
        possible = F.contains("t", F.lit(HINT[kind])) if kind in HINT else F.col("figures")
        whole = whole.withColumn(f"base_{kind}", F.when(possible, placed(F.col("t"), pattern)).otherwise(none))
        parts.append((kind, f"base_{kind}", None))
    for kind, pattern in LOOSE.items():
        possible = {"email": F.col("spelt"), "secret": F.col("run")}.get(kind, F.col("figures") & F.col("t").rlike(pattern))
        whole = whole.withColumn(f"loose_{kind}", F.when(possible, placed(F.col("t"), pattern)).otherwise(none))
        parts.append((kind, f"loose_{kind}", LOOSELY))
    whole = whole.drop("t", "figures", "spelt", "run")

    def voted(kind: str, column: str, origin: int | None) -> Column:
        def one(x: Column) -> Column:
            come = F.lit(origin) if origin is not None else F.when(checked(kind, x["match"]), PASSED).otherwise(FAILED)
            return F.struct(x["begin"].alias("begin"), F.lit(ALL_KINDS.index(kind)).alias("kind"), x["end"].alias("end"), come.alias("origin"), votes(kind, come, x["match"], x["context"]).alias("votes"), shape_of(x["match"], x["context"]).alias("shape"))

        return F.transform(column, one).cast(CANDIDATES)

    return whole.select("doc_id", F.concat(*[voted(*p) for p in parts]).alias("candidates"))


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """``counts`` of vote patterns (0 against, 1 none, 2 for) -> the posterior that a pattern's spans are personal data."""
    n = len(next(iter(counts)))
    prior = 0.5
    # chance of each vote given the truth: at first labelers are thought right four times in five
    given = {1: [[0.1, 0.3, 0.6]] * n, 0: [[0.6, 0.3, 0.1]] * n}
    after: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for pattern in counts:
            logs = {t: math.log(p) + sum(math.log(given[t][k][v]) for k, v in enumerate(pattern)) for t, p in ((1, prior), (0, 1 - prior))}
            after[pattern] = 1 / (1 + math.exp(min(700, logs[0] - logs[1])))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (1 + sum(c * after[p] for p, c in counts.items())) / (2 + total)))
        for truth in (1, 0):
            weight = {p: c * (after[p] if truth else 1 - after[p]) for p, c in counts.items()}
            given[truth] = []
            for k in range(n):
                # ten earlier spans on which the labeler was right more often than not keep the two sides from changing places
                sums = [10 * x for x in ((0.1, 0.3, 0.6) if truth else (0.6, 0.3, 0.1))]
                for p, w in weight.items():
                    sums[p[k]] += w
                given[truth].append([s / sum(sums) for s in sums])
    return after


Key = tuple[int, int, tuple[int, ...], int]


def features(key: Key) -> list[float]:
    kind, origin, pattern, shape = key
    rest, before = divmod(shape, 3)
    rest, parted = divmod(rest, 2)
    length, variety = divmod(rest, 3)
    out = [1.0, float(origin == LOOSELY), float(parted), *[float(kind == k) for k in range(len(ALL_KINDS))]]
    out += [float(v == side) for v in pattern for side in (0, 2)]
    return out + [float(length == k) for k in range(4)] + [float(variety == k) for k in range(3)] + [float(before == k) for k in range(3)]


def span_classifier(counts: dict[Key, float], rounds: int = 400) -> dict[Key, float]:
    """Posteriors by EM over the votes of each kind, then a logistic model of votes, span and context fitted to them."""
    target: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in range(len(ALL_KINDS)):
        by_votes: dict[tuple[int, ...], float] = {}
        for (own, _, pattern, _), c in counts.items():
            if own == kind:
                by_votes[pattern] = by_votes.get(pattern, 0) + c
        if by_votes:
            target |= {(kind, pattern): p for pattern, p in expectation_maximisation(by_votes).items()}
    rows = {key: features(key) for key in counts}
    weights = [0.0] * len(next(iter(rows.values())))
    total = sum(math.sqrt(c) for c in counts.values())  # roots: a frequent pattern must not be the only one that is learned
    score = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * f for w, f in zip(weights, x))))))
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for key, x in rows.items():
            error = (score(x) - target[key[0], key[2]]) * math.sqrt(counts[key]) / total
            slope = [s + error * f for s, f in zip(slope, x)]
        weights = [w - 1.0 * s for w, s in zip(weights, slope)]
    return {key: score(x) for key, x in rows.items()}


def pattern_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**k % 3 for k in reversed(range(len(LABELERS))))


def spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): arrays of (begin, kind, end), kind as its place in ALL_KINDS, in order."""
    found, _ = stage(candidates(docs), "pii")
    table = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.origin", "c.votes", "c.shape").agg(F.count("*").alias("n"))
    rows = table.orderBy("kind", "origin", "votes", "shape").collect()  # a few hundred at most
    chance = span_classifier({(r.kind, r.origin, pattern_of(r.votes), r["shape"]): float(r.n) for r in rows}) if rows else {}
    codes = [(r.kind, r.votes, r["shape"]) for r in rows if r.origin == LOOSELY and pattern_of(r.votes).count(2) >= 2 and chance[r.kind, r.origin, pattern_of(r.votes), r["shape"]] >= least]
    plain = lambda x: F.struct(x["begin"].alias("begin"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("candidates", lambda x: x["origin"] == PASSED), plain))
    marked = found.withColumn("base", base)
    if codes:
        accept = F.array(*[F.lit(f"{kind}:{votes}:{shape}") for kind, votes, shape in codes])
        free = lambda x: ~F.exists("base", lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"]))
        more = F.filter("candidates", lambda x: (x["origin"] == LOOSELY) & F.array_contains(accept, F.concat_ws(":", x["kind"], x["votes"], x["shape"])) & free(x))
        return marked.select("doc_id", "base", F.array_sort(F.concat("base", F.transform(more, plain))).alias("spans"))
    return marked.select("doc_id", "base", F.col("base").alias("spans"))


def written(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["begin"], x["end"])), ",")


def query(documents: DataFrame) -> DataFrame:
    found = spans(documents.select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
