"""Personal data by weak supervision, in DataFrame operations only.

Candidates are all matches of four strict patterns, kept or failed, and of looser ones:
obfuscated e-mail addresses, phone numbers and cards inside runs that the strict patterns
give up, IPv6 addresses, and long random strings (the kind ``secret``, listed after the
four others). Labelers vote on each candidate: its check (the strict pattern's own, or the
format's), a gazetteer (top-level domains, issuer ranges, country and area codes, routable
networks, prefixes of access keys), the words before it, and its layout.
Expectation-maximisation over the counts of vote patterns, for all documents, estimates
how reliable each labeler is for each kind. The posteriors train a logistic classifier of
spans over the votes, the generator, the shape and the neighbouring words (hashed), which
decides on candidates that the strict patterns do not already give. The strict spans
always stay; an added span overlaps none of them and no added span before it.

What reaches the driver is one count for each (kind, votes), at most 405 rows, and the
features of ``TRAIN_SPANS`` candidates in hash order, whatever the input. Texts are read
once, and never shuffled.

Defined cases: null texts are empty; repeated rows are each searched; positions are code
points, end exclusive; an empty table gives no rows; extra columns are ignored. Patterns
are possessive and anchored at the start of runs, so that very long runs of letters or
digits cost linear time and no deep recursion; positions of very many matches are summed
in two levels.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# Kinds in the order in which equal starts are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LONG = "[A-Za-z0-9+/_=-]"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\+?1[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": rf"(?<!{_LONG}){_LONG}{{20,128}}+(?!{_LONG})",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Generic top-level domains (any two letters are a country's), issuer ranges of cards,
# calling codes of countries, prefixes of access keys, words that announce a kind.
TLDS = "aero app asia biz blog cat cloud com coop dev edu gov info int jobs mil mobi museum name net online org post pro shop site store tech tel top travel xyz"
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|352[89]|35[3-8]|30[0-5]|309|36|38|39|62|50|5[6-8]"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[7-9][0-9]|8[0578][0-9]|9[679][0-9]"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|AIza|ya29|eyJ|npm_|hf_|SG[.]"
CUES = {
    "email": "mail|e-mail|contact|write|reach|address",
    "ip": "ip|host|server|address|from|node|peer",
    "card": "card|visa|master|mastercard|amex|credit|debit|pay|paid",
    "phone": "phone|tel|telephone|call|mobile|fax|cell|text",
    "secret": "token|secret|key|apikey|api_key|passwd|password|pwd|auth|bearer|credential|credentials",
}

#: A candidate beyond the strict spans is taken from this probability on.
ACCEPT = 0.8
#: Candidates, in the order of a hash, that the classifier is trained on; buckets of its features.
TRAIN_SPANS, BUCKETS = 4000, 4096
LABELERS = ("check", "gazetteer", "context", "layout")
#: Reliabilities of checks that are known beforehand and not estimated: shares of true spans and of
#: others that pass. All cards pass theirs, and one random number in ten; numbers that no telephone
#: plan or network has are false whatever else speaks for them.
KNOWN = {"card": (0.999, 0.1), "ip": (0.999, 0.5), "phone": (0.99, 0.3)}
ALL_KINDS = (*KINDS, "secret")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = f"reverse({_digits(m)})"
    one = f"int(substring({d}, z, 1))"
    return f"pmod(aggregate(transform(sequence(1, length({d})), z -> if(z % 2 = 1, {one}, if({one} > 4, 2 * {one} - 9, 2 * {one}))), 0, (a, b) -> a + b), 10) = 0"


def _q(pattern: str) -> str:
    return "r'" + pattern + "'"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"{m} rlike {_q(f'^{_OCTET}([.]{_OCTET}){{3}}$')}"
    if kind == "card":
        return f"case when length({_digits(m)}) between 14 and 19 then {_luhn(m)} else false end"
    if kind == "phone":
        return f"length({_digits(m)}) between 10 and 15"
    return "true"


def _votes(kind: str, m: str, before: str, strict: bool) -> list[str]:
    """SQL for the votes of LABELERS: 1, -1, or 0 for none."""
    domain = f"lower(regexp_extract(right({m}, 24), '([A-Za-z0-9-]+)$', 1))"
    nanp = f"regexp_extract({m}, '([0-9]{{3}}[^0-9]*[0-9]{{3}}[^0-9]*[0-9]{{4}})$', 1)"
    check = {
        "email": "1" if strict else "0",
        "ip": f"if({_valid(kind, m)}, 1, -1)" if strict else "0",
        "card": f"if({_valid(kind, m)}, 1, -1)",
        "phone": f"if({_valid(kind, m)}, 1, -1)" if strict else f"if({_digits(nanp)} rlike '^[2-9][0-8][0-9][2-9]', 1, -1)",
        "secret": f"if({m} rlike '[0-9]' and {m} rlike '[A-Za-z]', 1, -1)",
    }[kind]
    gazetteer = {
        "email": f"if(array_contains(split('{TLDS}', ' '), {domain}) or {domain} rlike '^[a-z]{{2}}$', 1, -1)",
        "ip": f"if(cast(right(regexp_extract({m}, '^([0-9]+)', 1), 3) as int) between 1 and 223, 1, -1)" if strict else f"if({m} rlike '(?i)^([23]|f[cde])', 1, -1)",
        "card": f"if({_digits(m)} rlike '^({ISSUERS})', 1, -1)",
        "phone": f"if({_digits(m)} rlike '^({CALLING})', 1, -1)",
        "secret": f"if({m} rlike '^({PREFIXES})' or {m} rlike '^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$', 1, -1)",
    }[kind]
    layout = {
        "email": f"if(left({m}, 80) rlike '[.]{{2}}|^[.]', -1, 1)",
        "ip": f"if({m} rlike '(^|[.])0[0-9]', -1, 1)",
        "card": f"if({m} rlike '^([0-9]{{13,19}}|[0-9]{{4}}([ -][0-9]{{4}}){{2,3}}([ -][0-9]{{1,3}})?|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})$', 1, -1)",
        "phone": f"if(left({m}, 40) rlike '[(][^)]*$|^[^(]*[)]|[.-]{{2}}', -1, 1)",
        "secret": f"if({before} rlike r'[=:]\\s*[\\x22\\x27]?$', 1, -1)",
    }[kind]
    silent = -1 if kind == "secret" else 0
    return [check, gazetteer, f"if({before} rlike r'(?i)(?<![a-z])({CUES[kind]})(?![a-z])', 1, {silent})", layout]


def _found(pattern: str, gate: str, name: str):
    """Two columns: matches and the gaps around them; none where ``gate`` is false."""
    p = _q(pattern)
    return {f"m_{name}": F.expr(f"if({gate}, regexp_extract_all(text, {p}, 0), cast(array() as array<string>))"), f"g_{name}": F.expr(f"if({gate}, split(text, {p}, -1), cast(array() as array<string>))")}


def _spans(kind: str, name: str, strict: bool) -> tuple[str, str]:
    """Lengths of gap and match, and an array of structs (start, kind, end, ok, votes, features) of the matches."""
    k, m, g = ALL_KINDS.index(kind), f"m_{name}", f"g_{name}"
    size = f"zip_with({g}, {m}, (x, y) -> length(x) + length(coalesce(y, '')))"
    at = f"(p_{name}[int(i div c_{name})] + aggregate(slice(l_{name}, int(i div c_{name}) * c_{name} + 1, int(i % c_{name})), 0L, (a, b) -> a + b) + length({g}[int(i)]))"
    it, before, after = f"{m}[int(i)]", f"right({g}[int(i)], 24)", f"left({g}[int(i) + 1], 24)"
    votes = _votes(kind, it, before, strict)
    ok = _valid(kind, it) if strict else "false"
    seen = {
        "shape": f"left(regexp_replace(regexp_replace(left({it}, 60), '[0-9]', '9'), '[A-Za-z]+', 'a'), 24)",
        "size": f"string(least(length({it}) div 8, 8))",
        "word": f"lower(regexp_extract({before}, '([A-Za-z]+)[^A-Za-z]*$', 1))",
        "next": f"lower(regexp_extract({after}, '^[^A-Za-z]*([A-Za-z]+)', 1))",
    }
    features = [f"hash('{name}')", *[f"hash('{name} {w}', {x})" for w, x in seen.items()]]
    features = ", ".join(f"pmod({x}, {BUCKETS})" for x in features)
    named = ", ".join(f"{v} as v{n}" for n, v in enumerate(votes))
    # l and p are named twice, so that the optimizer keeps them as columns instead of working them out for each match
    return size, f"transform(filter(sequence(0L, cast(size(l_{name}) as bigint)), i -> i < size({m}) and size(p_{name}) > 0), i -> struct({at} as start, {k} as kind, {at} + length({it}) as end, {ok} as ok, {named}, array({features}) as seen))"


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: ``strict`` spans that pass and all ``found`` candidates with their votes and features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = [
        ("email", "email", STRICT["email"], "contains(text, '@')", True),
        ("ip", "ip", STRICT["ip"], "text rlike '[0-9][.][0-9]'", True),
        ("card", "card", STRICT["card"], "text rlike '[0-9][ -]?[0-9]'", True),
        ("phone", "phone", STRICT["phone"], "contains(text, '+')", True),
        ("email", "email2", LOOSE["email"], "contains(text, '[at]') or contains(text, '(at)')", False),
        ("ip", "ip2", LOOSE["ip"], "text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]'", False),
        ("card", "card2", LOOSE["card"], "text rlike '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}'", False),
        ("phone", "phone2", LOOSE["phone"], "text rlike '[0-9]{3}[ .-][0-9]{4}'", False),
        ("secret", "secret2", LOOSE["secret"], f"text rlike '{_LONG}{{20}}'", False),
    ]
    cols = {}
    for _, name, pattern, gate, _ in parts:
        cols |= _found(pattern, gate, name)
    rows = rows.select("doc_id", *[c.alias(n) for n, c in cols.items()])
    made = {n: _spans(kind, n, strict) for kind, n, _, _, strict in parts}
    rows = rows.select("*", *[F.expr(size).alias(f"l_{n}") for n, (size, _) in made.items()])
    rows = rows.select("*", *[F.expr(f"cast(greatest(1, ceil(sqrt(size(l_{n})))) as int)").alias(f"c_{n}") for n in made])
    rows = rows.select("*", *[F.expr(f"transform(sequence(0, int(size(l_{n}) div c_{n})), j -> aggregate(slice(l_{n}, j * c_{n} + 1, c_{n}), 0L, (a, b) -> a + b))").alias(f"q_{n}") for n in made])
    rows = rows.select("*", *[F.expr(f"transform(sequence(0, size(q_{n}) - 1), j -> aggregate(slice(q_{n}, 1, j), 0L, (a, b) -> a + b))").alias(f"p_{n}") for n in made])
    found = rows.select("doc_id", F.concat(*[F.expr(sql) for _, sql in made.values()]).alias("found"))
    strict = F.array_sort(F.transform(F.filter("found", lambda s: s["ok"]), _span))
    return found.select("doc_id", strict.alias("strict"), "found")


def _span(s):
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict, dict]:
    """Expectation-maximisation on counted votes (kind, votes, count).

    Returns the posterior of each (kind, votes) and, per kind and labeler, the shares
    (true positives among true spans, false positives among others). Counts are smoothed
    by one, so that a labeler without votes stays at one half.
    """
    post, rates = {}, {}
    for kind in sorted({c[0] for c in counts}):
        own: dict[tuple[int, ...], float] = {}
        for k, votes, n in counts:
            if k == kind:
                own[votes] = own.get(votes, 0) + n
        known = KNOWN.get(ALL_KINDS[kind])
        p = {v: 1 / (1 + math.exp(-2.0 * ((3 if known else 1) * v[0] + sum(v[1:])))) for v in own}
        for _ in range(rounds):
            yes, no = sum(p[v] * n for v, n in own.items()), sum((1 - p[v]) * n for v, n in own.items())
            rate = []
            for j in range(len(LABELERS)):
                tp = sum(p[v] * n for v, n in own.items() if v[j] > 0)
                fn = sum(p[v] * n for v, n in own.items() if v[j] < 0)
                fp = sum((1 - p[v]) * n for v, n in own.items() if v[j] > 0)
                tn = sum((1 - p[v]) * n for v, n in own.items() if v[j] < 0)
                rate.append(known if known and j == 0 else ((tp + 1) / (tp + fn + 2), (fp + 1) / (fp + tn + 2)))
            prior = math.log((yes + 1) / (no + 1))
            for v in own:
                z = prior
                for j, (s, f) in enumerate(rate):
                    z += math.log(s / f) if v[j] > 0 else math.log((1 - s) / (1 - f)) if v[j] < 0 else 0.0
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        post |= {(kind, v): x for v, x in p.items()}
        rates[kind] = rate
    return post, rates


def features(kind: int, votes: tuple[int, ...], seen: list[int]) -> list:
    """The names of what the classifier sees of a candidate: kind, votes, and buckets of generator, shape, size and words."""
    return [("k", kind), *[(kind, j, v) for j, v in enumerate(votes)], *seen]


def classifier(rows: list[tuple[int, tuple[int, ...], list[int]]], post: dict, epochs: int = 15, rate: float = 0.5) -> dict:
    """Weights of a logistic classifier of candidates (kind, votes, seen), fitted to the posteriors by adaptive gradient steps."""
    weight: dict = {}
    square: dict = {}
    table_ = [(features(k, v, seen), post[k, v]) for k, v, seen in rows]
    for _ in range(epochs):
        for f, y in table_:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(x, 0.0) for x in f)))))
            for x in f:
                d = p - y + 1e-4 * weight.get(x, 0.0)
                square[x] = square.get(x, 1e-6) + d * d
                weight[x] = weight.get(x, 0.0) - rate * d / math.sqrt(square[x]) * min(1.0, abs(d) + 0.1)
    return weight


def personal_data(docs: DataFrame, accept: float = ACCEPT, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """Per document: ``strict`` and all ``spans``, arrays of (start, kind, end)."""
    rows = written(candidates(docs), "candidates")
    names = [f"v{j}" for j in range(len(LABELERS))]
    each = rows.select("doc_id", F.explode("found").alias("s"))
    votes = [F.col(f"s.{v}") for v in names]
    counted = each.groupBy(F.col("s.kind").alias("kind"), *votes).agg(F.count("*").alias("c")).collect()
    counts = sorted((r[0], tuple(r[1 : 1 + len(names)]), r[-1]) for r in counted)
    if not counts:
        return rows.select("doc_id", "strict", F.col("strict").alias("spans"))
    post, _ = reliabilities(counts)
    order = [F.xxhash64("doc_id", "start", "kind"), F.col("doc_id"), F.col("start"), F.col("kind")]
    sample = each.select("doc_id", "s.*").orderBy(*order).limit(train_spans).collect()
    weight = classifier([(r.kind, tuple(r[v] for v in names), r.seen) for r in sample], post)
    # what a (kind, votes) and a bucket weigh, as two folded literals
    held = {f"{k}|{'|'.join(map(str, v))}": sum(weight.get(x, 0.0) for x in features(k, v, [])) for k, v, _ in counts}
    by_votes = F.expr(f"map_from_arrays(split('{','.join(held)}', ','), cast(split('{','.join(map(repr, held.values()))}', ',') as array<double>))")
    by_bucket = F.expr(f"cast(split('{','.join(repr(weight.get(k, 0.0)) for k in range(BUCKETS))}', ',') as array<double>)")
    least = math.log(accept / (1 - accept))

    def taken(s):
        own = by_votes[F.concat_ws("|", s["kind"].cast("string"), *[s[v].cast("string") for v in names])]
        return F.aggregate(s["seen"], own, lambda a, k: a + by_bucket[k]) >= F.lit(least)

    extra = F.filter("found", lambda s: ~s["ok"] & taken(s) & ~F.exists("strict", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.select("doc_id", "strict", F.array_sort(F.array_distinct(F.transform(extra, _span))).alias("extra"))
    apart = F.filter("extra", lambda s, i: (i == 0) | (F.col("extra")[i - 1]["end"] <= s["start"]))
    return rows.select("doc_id", "strict", F.array_sort(F.concat("strict", apart)).alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def _text(col: str):
    name = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("strict", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_text("strict"), 256).alias("base_sha256"), _text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
