"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

1. Candidates: the base patterns (always kept) and looser kinds that need support (secrets named by a word, keys that name
   their service, IBANs, social security numbers). Every document is one row and its candidates are one small array; nothing is shuffled.
2. Votes: five labelers say 1, 0 or -1 to each candidate. How often each combination of kind, votes and shape features
   occurs over all documents is one aggregation; its size is bounded by the number of combinations
   (kinds x 3^labelers x feature values), not by the data.
3. Expectation-maximisation over those counts gives each labeler's reliability for each kind, and with the posterior
   as soft labels a span classifier (naive Bayes over votes and shape) is trained. Both are closed-form sums.
4. The classifier is a literal map of the plan: it scores the candidates in the projection; base spans stay, other
   candidates stay from `threshold` on.

Only DataFrame functions run on the executors. Positions are code points, ends exclusive.

Cases: null and empty texts have no spans; very long texts are read whole, with possessive patterns that neither
backtrack nor recurse; repeated rows and ids are read one by one; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sha256_text, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "key", "iban", "ssn")

#: How keys that name their service begin (fixed values).
KEY_GATE = r"AKIA[0-9A-Z]|gh[pousr]_|xox[abprs]-|sk-[A-Za-z0-9]|AIza|eyJ|-----BEGIN "

#: kind -> (cheap gate, pattern). The base patterns match what the plain ones do: possessive quantifiers where greedy
#: ones could never give back, and starts inside a run that has already failed are skipped.
PATTERNS: dict[str, tuple[str, str]] = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": ("(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\\s*[=:]", "(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\\s*+[=:]\\s*+[\"']?[A-Za-z0-9+/_!@#$%^&*.-]{8,}+"),
    "key": (KEY_GATE, r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|-----BEGIN (?:(?!PRIVATE)[A-Z]+ ){0,3}+PRIVATE KEY-----"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    "ssn": ("[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}

#: Words that speak for a kind when they stand just before a candidate (fixed values).
CUES = {
    "email": "mail|contact|write|reach|address|from|to",
    "ip": "ip|host|server|address|addr|client|from|login",
    "card": "card|visa|master|amex|credit|debit|payment|pay|number|no",
    "phone": "phone|tel|call|mobile|cell|fax|contact|sms|whatsapp",
    "secret": "password|passwd|secret|token|key|auth|credential|login",
    "key": "key|token|secret|credential|auth|bearer|private|aws|github|slack",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|tax",
}
AGAINST = "version|ver|isbn|issn|chapter|section|figure|table|example|sample|dummy|test"

#: What a candidate's own text looks like when a gazetteer knows it (fixed values).
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|uk|us|ca|au|jp|ch|at|be|eu)$",
    "ip": r"^(?!0|127\.|255\.|169\.254\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"[0-9]",
    "key": r"^(?:AKIA|gh[pousr]_|xox|sk-|AIza|eyJ|-----)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
LABELERS = ("pattern", "gazetteer", "cue", "against", "edges")
CANDIDATE = "array<struct<kind:string,start:int,end:int,votes:string,shape:string,base:boolean>>"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: counted from the right, every second digit is doubled, over 9 less 9."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "ip":
        return m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str) -> Column:
    """All valid matches of a kind with votes and shape. What stands between the matches gives their places."""
    gate, rx = PATTERNS[kind]
    between, found = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    spot = "array<struct<m:string,start:int,before:string,after:string>>"
    acc = F.struct(F.lit(0).alias("at"), F.array().cast(spot).alias("got"))

    def step(a: Column, x: Column) -> Column:
        b, m, after = x["b"], x["m"], x["a"]
        start = a["at"] + F.length(b)
        one = F.struct(m.alias("m"), start.alias("start"), F.right(b, F.lit(30)).alias("before"), F.left(after, F.lit(20)).alias("after"))
        return F.struct((start + F.length(m)).alias("at"), F.when(_valid(kind, m), F.concat(a["got"], F.array(one))).otherwise(a["got"]).alias("got"))

    joined = F.transform(found, lambda m, i: F.struct(F.get(between, i).alias("b"), m.alias("m"), F.get(between, i + 1).alias("a")))
    spots = F.aggregate(joined, acc, step, lambda a: a["got"])

    def judged(x: Column) -> Column:
        m, before, after = x["m"], x["before"], x["after"]
        yes, vote = lambda c: F.when(c, "1").otherwise("0"), lambda c: F.when(c, "1").otherwise("-")
        strict = {"email": r"^[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9]", "secret": r"[A-Za-z0-9+/_-]{16,}$", "key": r"[0-9]|^-----", "phone": r"^\+[0-9]{1,3}[\x20(.-]"}.get(kind, ".")
        votes = F.concat(
            vote(m.rlike(strict)), vote(m.rlike(GAZETTEER[kind])), yes(before.rlike(rf"(?i)(?<![a-z])(?:{CUES[kind]})(?![a-z])")),
            F.when(before.rlike(rf"(?i)(?<![a-z])(?:{AGAINST})[^a-z]*$"), "-").otherwise("0"),
            vote(~before.rlike(r"[\p{L}\p{N}_.]$") & ~after.rlike(r"^[\p{L}\p{N}_@]")),
        )
        shape = F.concat(F.least(F.length(m) / 8, F.lit(5)).cast("int").cast("string"), yes(m.rlike(r"[\x20-]")), yes(m.rlike("([0-9])\\1\\1\\1")))
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(m)).alias("end"),
            votes.alias("votes"), shape.alias("shape"), F.lit(kind in BASE).alias("base"))

    return F.when(text.rlike(gate), F.transform(spots, judged)).otherwise(F.array().cast(CANDIDATE))


def candidates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id and its candidate spans. Texts without a digit or @ or a secret's = are passed by."""
    d = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    every = F.concat(*[_candidates(F.col("_t"), k) for k in KINDS])
    return d.select("doc_id", F.when(F.col("_t").rlike(f"[0-9@]|[=:]|{KEY_GATE}"), every).otherwise(F.array().cast(CANDIDATE)).alias("found"))


def fit(counts: dict[tuple[str, str, str], int], rounds: int = 40) -> dict[str, dict]:
    """kind -> prior, reliability of each labeler, and the classifier's weights, from the counts of combinations."""
    model = {}
    for kind in KINDS:
        rows = {(v, s): n for (k, v, s), n in counts.items() if k == kind}
        prior = 0.7
        # at first a labeler is believed to be right four times in five
        says = [{y: {v: (0.8 if (v == "1") == bool(y) else 0.2) if v != "0" else 0.5 for v in "10-"} for y in (0, 1)} for _ in LABELERS]
        post: dict[tuple[str, str], float] = {}
        for _ in range(rounds):
            for v, s in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(says[j][1][x] / says[j][0][x]) for j, x in enumerate(v))
                post[v, s] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            total = sum(rows.values())
            prior = min(0.99, max(0.01, (sum(n * post[k] for k, n in rows.items()) + 7) / (total + 10)))
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    # the prior counts keep a labeler that never disagrees from being believed without end
                    seen = {x: 8 * (0.8 if (x == "1") == bool(y) else 0.2) if x != "0" else 4.0 for x in "10-"}
                    for (v, s), n in rows.items():
                        seen[v[j]] += n * (post[v, s] if y else 1 - post[v, s])
                    says[j][y] = {x: c / sum(seen.values()) for x, c in seen.items()}
        weights: dict[str, float] = {"": math.log(prior / (1 - prior))}
        for j in range(len(LABELERS) + 1):  # each labeler, and the shape as one more feature
            mass: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
            for (v, s), n in rows.items():
                x = v[j] if j < len(LABELERS) else s
                mass[x][1] += n * post[v, s]
                mass[x][0] += n * (1 - post[v, s])
            sums = [sum(m[y] for m in mass.values()) or 1.0 for y in (0, 1)]
            weights |= {f"{j}{x}": math.log(m[1] / sums[1]) - math.log(m[0] / sums[0]) for x, m in mass.items()}
        model[kind] = {"prior": prior, "reliability": {name: says[j] for j, name in enumerate(LABELERS)}, "weights": weights}
    return model


def find_pii(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id and spans (kind, start, end, base, p), in the order of KINDS, then of start."""
    found = cut(candidates(df, text_col, id_col))
    c = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    model = fit({(r["kind"], r["votes"], r["shape"]): r["count"] for r in c.collect()})  # bounded: see step 2
    weights = {f"{kind}/{k}": w for kind, m in model.items() for k, w in m["weights"].items()}
    table = F.create_map(*[F.lit(x) for kw in sorted(weights.items()) for x in kw])
    weight = lambda x, k: F.coalesce(F.element_at(table, F.concat(x["kind"], F.lit("/"), k)), F.lit(0.0))

    def scored(x: Column) -> Column:
        z = weight(x, F.lit("")) + weight(x, F.concat(F.lit(str(len(LABELERS))), x["shape"]))
        for j in range(len(LABELERS)):
            z = z + weight(x, F.concat(F.lit(str(j)), F.substring(x["votes"], j + 1, 1)))
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), (1 / (1 + F.exp(-z))).alias("p"))

    spans = F.filter(F.transform("found", scored), lambda x: x["base"] | (x["p"] >= threshold))
    return found.select("doc_id", spans.alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS] + [F.size("spans").cast("long").alias("n_spans")]
    return find_pii(documents(spark, sf_dir)).select("doc_id", *n, sha256_text(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
