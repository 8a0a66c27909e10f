"""Personal data and secrets: base patterns, and a weakly supervised classifier of further spans.

All of it is column expressions: spans come from splitting a text at a pattern and adding up the
lengths of pieces and matches, so the plan is a scan with a projection and no exchange. Running sums
and maxima go block by block (_before), and arrays and texts are bound once (let) instead of being
made anew for each element, so the work of one text is linear in its length and its matches.

Weak supervision: candidate tokens (runs of word characters, LEAST_TOKEN or longer, with a digit or
the prefix of a key) get votes from labelers of three kinds, patterns, gazetteers, context: 0 nothing personal, 1 a secret, 2
an account or identity number, or none. Votes and features are counted over all candidates of all
texts; only the distinct combinations reach the driver. Expectation-maximisation (a reliability for
each labeler, class and vote; silent labelers left out) turns votes into probabilities of the three
classes; these weigh a naive Bayes classifier over the span's features, which judges each candidate.
Base spans always stay; a candidate that lies within one is dropped.

Patterns are possessive and start at the end of the last match or at the start of a run, which finds
the same matches as the plain ones without going over a long run again from each of its characters.

Defined cases: a null text is empty and has no spans. Tables without candidates give no further
spans. Repeated rows and other columns, pii_spans apart, which is replaced, change nothing but the
counts that the classifier learns from.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, table

KINDS = ("email", "ip", "card", "phone", "secret", "account")
_LOCAL, _DIGIT = r"[A-Za-z0-9._%+-]", r"[0-9]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:\G|(?<!{_DIGIT})){_DIGIT}++\.{_DIGIT}++\.{_DIGIT}++\.{_DIGIT}++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap necessary condition of a valid match of each pattern.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9]"}
LEAST_TOKEN, CONTEXT = 10, 24
# Words before a value, prefixes of issued keys, and lengths of IBANs by country (ISO 13616).
SECRET_WORDS = ("password", "passwd", "passphrase", "pwd", "pin", "token", "secret", "apikey", "api_key", "api-key", "key", "credential", "credentials", "auth", "authorization", "bearer", "login", "passwort", "kennwort", "clave", "contraseña", "mdp", "jeton")
ACCOUNT_WORDS = ("account", "acct", "iban", "bic", "konto", "kontonummer", "compte", "cuenta", "passport", "reisepass", "passeport", "pasaporte", "ssn", "social", "insurance", "tax", "vat", "nif", "dni", "siret", "patient", "member", "customer", "policy", "licence-no", "id-no")
PLAIN_WORDS = ("version", "page", "figure", "isbn", "issn", "doi", "license", "licence", "section", "chapter", "year", "table", "http", "https", "www", "arxiv", "commit", "build", "model", "part", "rfc", "iso", "sku", "lot")
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "npm_", "pypi-", "hf_", "dop_v1_", "shpat_", "eyJ")
_PREFIX = "|".join(KEY_PREFIXES)
#: A prefix is tried only where its first letter stands.
_FIRST = "".join(sorted({p[0] for p in KEY_PREFIXES}))
CANDIDATE = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9]|(?=[{_FIRST}])(?:{_PREFIX}))[A-Za-z0-9_-]{{{LEAST_TOKEN},}}+"
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26}
_SPAN = "array<struct<start:int,end:int,m:string,before:string>>"
_FOUND = "array<struct<start:int,k:int,end:int>>"
ROUNDS, PRIOR, CLASSES, BLOCK, CHUNK = 50, 1.0, 3, 256, 1024


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers, what add makes of 0 and all those before it. Sums are kept by blocks,
    so that appending to an array copies a block at most, or the list of blocks."""
    empty = F.array().cast("array<int>")

    def running(items: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), empty.alias("out"))
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, zero, step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda i: F.slice(v, i + 1, F.lit(BLOCK)))
        first = lambda blocks: running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0))
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, first(blocks), running)))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(empty))


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, m, before) of the matches; before is the text between the last match and this one, its end at most."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("m"), F.right(p, F.lit(CONTEXT)).alias("before"))
    pairs = F.filter(F.zip_with(found, pieces, pair), lambda x: x["m"].isNotNull())

    def placed(p: Column) -> Column:
        at = _before(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        one = lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["size"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"))
        return F.zip_with(p, at, one)

    return let(pairs, placed)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) > 3, F.lit(False)).when(F.length(p) == 0, F.lit(True)).otherwise(F.expr("true") & (F.lpad(p, 3, "0") <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.when(F.rlike(text, F.lit(GATES[kind])), spans(text, PATTERNS[kind])).otherwise(F.array().cast(_SPAN))
    return F.filter(found, lambda s: _valid(kind, s["m"]))


def candidates(text: Column) -> Column:
    gate = F.rlike(text, F.lit("[0-9]"))
    for p in KEY_PREFIXES:
        gate = gate | F.contains(text, F.lit(p))
    return F.when(gate, spans(text, CANDIDATE)).otherwise(F.array().cast(_SPAN))


def _last_word(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"([A-Za-z_-]+)[^A-Za-z_-]*$", 1))


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _iban(m: Column) -> Column:
    sizes = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    return F.rlike(m, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")) & (F.length(m) == F.coalesce(F.element_at(sizes, F.substring(m, 1, 2)), F.lit(-1)))


def labelers(m: Column, before: Column) -> dict[str, Column]:
    """Votes on a candidate: 1 secret, 2 account or identity number, 0 neither, null silent."""
    word = _last_word(before)
    letters = F.length(m) - _digits(m)
    votes = {
        "pattern_key": F.when(F.rlike(m, F.lit("^[A-Z]{4}[0-9A-Z]{16}$")), 1),
        "pattern_hex": F.when(F.rlike(m, F.lit("^[0-9a-f]{16,}$")) & F.rlike(m, F.lit("[a-f]")), 1),
        "pattern_mixed": F.when((_digits(m) >= 3) & (letters >= 3) & ~F.rlike(m, F.lit("[_-]")), 1).when(F.rlike(m, F.lit("^[0-9_-]+$|^[A-Za-z_-]+[0-9]{1,2}$")), 0),
        "pattern_account": F.when(_iban(m) | F.rlike(m, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), 2),
        "gazetteer_prefix": F.when(F.rlike(m, F.lit(f"^({_PREFIX})")), 1),
        "gazetteer_secret": F.when(word.isin(*SECRET_WORDS), 1),
        "gazetteer_account": F.when(word.isin(*ACCOUNT_WORDS), 2),
        "gazetteer_plain": F.when(word.isin(*PLAIN_WORDS), 0),
        "context_assigned": F.when(F.rlike(before, F.lit("[=:]\\s*[\"']?$")), F.when(_digits(m) == F.length(m), 2).otherwise(1)).when(F.rlike(before, F.lit("[.,;]\\s*$")), 0),
        "context_in_word": F.when(F.rlike(before, F.lit(r"[/\\\[\]{}<>#*$%&|]$")), 0),
    }
    # A candidate that nothing else speaks for is most likely an ordinary word.
    return votes | {"silence": F.when(F.coalesce(*votes.values()).isNull(), 0)}


def features(m: Column, before: Column) -> dict[str, Column]:
    size = F.length(m)
    word = _last_word(before)
    return {
        "length": F.when(size < 14, 0).when(size < 20, 1).when(size < 28, 2).otherwise(3),
        "digits": F.floor(4 * _digits(m) / size).cast("int"),
        "case": F.when(F.rlike(m, F.lit("^[0-9A-Z]+$")), 0).when(F.rlike(m, F.lit("^[0-9a-z]+$")), 1).when(F.rlike(m, F.lit("^[0-9A-Za-z]+$")), 2).otherwise(3),
        "hex": F.when(F.rlike(m, F.lit("^[0-9a-fA-F]+$")), 1).otherwise(0),
        "turns": F.least(F.lit(3), F.floor(F.regexp_count(m, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")) / 2)).cast("int"),
        "assigned": F.when(F.rlike(before, F.lit("[=:]\\s*[\"']?$")), 1).otherwise(0),
        "named": F.when(word.isin(*SECRET_WORDS), 1).when(word.isin(*ACCOUNT_WORDS), 2).when(word.isin(*PLAIN_WORDS), 3).otherwise(0),
        "prefix": F.when(F.rlike(m, F.lit(f"^({_PREFIX})")), 1).otherwise(0),
        "shape": F.when(_iban(m), 1).when(F.rlike(m, F.lit("^[0-9]+(-[0-9]+)+$")), 2).otherwise(0),
    }


Rates = dict[str, list[list[float]]]


def estimate(counts: list[tuple[dict[str, int | None], float]]) -> tuple[list[list[float]], Rates]:
    """Expectation-maximisation over vote combinations and their counts: each combination's
    probability of each class, and by labeler P(vote | class), as [class][vote]."""
    names, total = sorted({k for votes, _ in counts for k in votes}), sum(n for _, n in counts)
    post = []
    for votes, _ in counts:
        said = [v for v in votes.values() if v is not None]
        start = [said.count(c) + 0.25 for c in range(CLASSES)] if said else [0.9, 0.05, 0.05]
        post.append([x / sum(start) for x in start])
    rates: Rates = {}
    for _ in range(ROUNDS):
        share = [(sum(p[c] * n for p, (_, n) in zip(post, counts, strict=True)) + PRIOR) / (total + CLASSES * PRIOR) for c in range(CLASSES)]
        for k in names:
            rates[k] = []
            for c in range(CLASSES):
                # The prior and the bounds hold labelers to being right more often than not.
                seen = [2 * PRIOR if v == c else PRIOR / 2 for v in range(CLASSES)]
                for p, (votes, n) in zip(post, counts, strict=True):
                    if votes[k] is not None:
                        seen[votes[k]] += p[c] * n
                rates[k].append([(max if v == c else min)(x / sum(seen), 0.5) for v, x in enumerate(seen)])
        new = []
        for votes, _ in counts:
            log = [math.log(share[c]) + sum(math.log(rates[k][c][v]) for k, v in votes.items() if v is not None) for c in range(CLASSES)]
            odds = [math.exp(x - max(log)) for x in log]
            new.append([x / sum(odds) for x in odds])
        post = new
    return post, rates


class SpanClassifier:
    """Log-odds against class 0 by class and feature value, trained on the probabilities that the labelers' votes give."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[int, list[float]]] = {}
        self.bias, self.rates = [0.0] * CLASSES, {}

    def fit(self, docs: DataFrame, text: str = "text") -> SpanClassifier:
        # An inner explode would make Spark infer a filter that looks for all candidates once more.
        c = docs.select(F.explode_outer(candidates(F.coalesce(text, F.lit("")))).alias("c")).where("c is not null").select("c.m", "c.before")
        votes, feats = labelers(F.col("m"), F.col("before")), features(F.col("m"), F.col("before"))
        flat = c.select(*(v.alias(f"v_{k}") for k, v in votes.items()), *(f.alias(f"f_{k}") for k, f in feats.items()))
        rows = [r.asDict() for r in flat.groupBy(*flat.columns).count().collect()]
        rows.sort(key=lambda r: str(sorted(r.items())))
        if not rows:
            return self
        combos: dict[tuple, float] = {}
        for r in rows:
            key = tuple(r[f"v_{k}"] for k in votes)
            combos[key] = combos.get(key, 0.0) + r["count"]
        post, self.rates = estimate([(dict(zip(votes, k, strict=True)), n) for k, n in combos.items()])
        chance = dict(zip(combos, post, strict=True))
        total = [PRIOR] * CLASSES
        seen: dict[str, dict[int, list[float]]] = {k: {r[f"f_{k}"]: [PRIOR] * CLASSES for r in rows} for k in feats}
        for r in rows:
            part = [p * r["count"] for p in chance[tuple(r[f"v_{k}"] for k in votes)]]
            total = [t + x for t, x in zip(total, part, strict=True)]
            for k in feats:
                cell = seen[k][r[f"f_{k}"]]
                cell[:] = [t + x for t, x in zip(cell, part, strict=True)]
        self.bias = [math.log(t / total[0]) for t in total]
        for k, cells in seen.items():
            sums = [sum(x[c] for x in cells.values()) for c in range(CLASSES)]
            log = {v: [math.log(x[c] / sums[c]) for c in range(CLASSES)] for v, x in sorted(cells.items())}
            self.weights[k] = {v: [y - x[0] for y in x] for v, x in log.items()}
        return self

    def judged(self, m: Column, before: Column) -> Column:
        """The likeliest class of a candidate."""
        if not self.weights:
            return F.lit(0)
        feats = F.struct(*(f.alias(k) for k, f in features(m, before).items()))

        def odds(x: Column, c: int) -> Column:
            out = F.lit(self.bias[c])
            for k, w in self.weights.items():
                known = F.create_map(*(F.lit(z) for v, y in w.items() for z in (v, y[c])))
                out = out + F.coalesce(F.element_at(known, x[k]), F.lit(0.0))
            return out

        best = lambda x: F.when(F.greatest(x["a"], x["b"]) <= 0, 0).when(x["a"] >= x["b"], 1).otherwise(2)
        return let(feats, lambda x: let(F.struct(odds(x, 1).alias("a"), odds(x, 2).alias("b")), best))


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def spans_of(text: Column, model: SpanClassifier) -> Column:
    """A sorted array of (start, k, end), k counting KINDS; code points, end exclusive."""
    body = F.coalesce(text, F.lit(""))
    base = [_tagged(base_spans(body, k), k) for k in KINDS[:4]]
    told = F.transform(candidates(body), lambda s: F.struct(s["start"].alias("start"), (model.judged(s["m"], s["before"]) + 3).alias("k"), s["end"].alias("end")))
    more = F.filter(told, lambda s: s["k"] > 3) if model.weights else F.array().cast(_FOUND)

    def outside(every: Column) -> Column:
        """Without candidates within a base span: in order of start, one whose end is not above all base ends before it."""
        reach = _before(F.transform(every, lambda s: F.when(s["k"] < 4, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        marked = F.zip_with(every, reach, lambda s, r: F.when((s["k"] < 4) | (s["end"] > r), s))
        return F.filter(marked, lambda s: s.isNotNull())

    return let(F.array_sort(F.concat(*base, more)), outside)


def found_spans(docs: DataFrame, model: SpanClassifier, text: str = "text") -> DataFrame:
    """docs plus pii_spans, as spans_of gives them."""
    return docs.withColumn("pii_spans", spans_of(F.col(text), model))


def told(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans_: Column) -> Column:
    """text with each span, or run of overlapping spans, put as its first kind in brackets."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def between(s: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the blocks that hold them: no prefix of the text is walked again."""
        one = lambda c: F.substring(F.get(s["blocks"], c), F.greatest(a - c * CHUNK, F.lit(0)) + 1, F.least(b - c * CHUNK, F.lit(CHUNK)) - F.greatest(a - c * CHUNK, F.lit(0)))
        own = F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int"))
        return F.when(b > a, F.array_join(F.transform(own, one), "")).otherwise("")

    def put(s: Column) -> Column:
        ends = F.transform(s["spans"], lambda x: x["end"])
        reach = _before(ends, lambda a, b: F.greatest(a, b))
        piece = lambda x, r: F.when(x["start"] >= r, F.concat(between(s, r, x["start"]), F.get(kinds, x["k"]))).otherwise("")
        last = between(s, F.coalesce(F.array_max(ends), F.lit(0)), s["size"])
        return F.array_join(F.concat(F.zip_with(s["spans"], reach, piece), F.array(last)), "")

    return let(F.struct(blocks.alias("blocks"), spans_.alias("spans"), F.length(text).alias("size")), put)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = found_spans(docs, SpanClassifier().fit(docs))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["k"] == k)).cast("long")
    counts = {f"n_{kind}": count(k) for k, kind in enumerate(KINDS)}
    base = F.filter("pii_spans", lambda s: s["k"] < 4)
    return out.select("doc_id", *(counts[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:4]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii_spans")).alias("spans"), counts["n_secret"].alias("n_secret"), counts["n_account"].alias("n_account"))
