"""Personal data: base patterns, and weakly supervised spans beside them. DataFrame functions only; the driver sees counts.

Every candidate, base or wider, is voted on by three labelers that look at different things: the span's own shape (regex),
lists of known values (gazetteer), and the words around it (context). Expectation-maximisation estimates from their
agreement how reliable each is, by kind, and so labels the candidates softly; a logistic span classifier is trained on these
labels from features of the span and its surroundings, and decides on the wider candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import stash

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns. They match as the plain forms do: \G and look-behind only skip starts that can't be leftmost, possessive
#: repeats only drop backtracking that can't help (and need no stack), and a card of under 12 digits would fail its test anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, searched beside the base ones of the kind; their matches are spans only if the classifier says so. All
#: repeats of groups are possessive.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\(\[](?:at|AT)[\)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[\(\[](?:dot|DOT)[\)\]] ?[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/.@-])[A-Za-z0-9_][A-Za-z0-9_+/-]{11,}+={0,2}+(?![@A-Za-z0-9])",
}
#: A candidate of the kind can only be where this matches.
_MAY = {"email": r"@|[\(\[](?:at|AT)[\)\]]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]|[0-9][ .-][0-9]{4}", "secret": r"[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Z]{16}"}

# Fixed word lists of the labelers, matched as whole words.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "example")
CALLING = ("1", "33", "34", "39", "44", "49", "52", "55", "61", "81", "86", "91")
KEYS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth", "key", "credential", "bearer")
NEAR = {
    "email": ("mail", "email", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "from", "client"),
    "card": ("card", "visa", "credit", "payment", "pay", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "cell", "llame", "appel"),
    "secret": ("password", "token", "secret", "key", "login", "credential", "credentials", "auth", "passwort", "clave"),
}
FAR = {
    "email": ("regex", "pattern"), "ip": ("version", "release", "section", "build", "chapter"), "card": ("isbn", "order", "invoice", "serial", "part"),
    "phone": ("order", "invoice", "isbn", "part", "model", "ratio", "score"), "secret": ("url", "http", "https", "www", "version", "file", "path", "commit", "checksum", "hash", "sha", "md5"),
}
#: A wider candidate becomes a span from this probability on.
CONFIDENT = 0.9
#: Matches whose lengths are summed by block and then inside it: an accumulator that holds the matches would be copied at
#: every step.
BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_MATCH = "struct<pos:int,m:string,before:string,after:string>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<pos, m, before, after>>: each match, its start in code points, and up to 40 and 20 characters around it."""
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)

    def in_block(block: Column, sizes: Column, at: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = at + total(F.slice(sizes, F.lit(1), i)) + F.length(x["g"])
            return F.struct(start.alias("pos"), x["m"].alias("m"), F.right(x["g"], F.lit(40)).alias("before"), F.left(x["h"], F.lit(20)).alias("after"))

        return F.transform(block, one)

    def placed(x: Column) -> Column:
        n = F.size(x["found"])
        zipped = F.arrays_zip(x["found"].alias("m"), F.slice(x["gaps"], F.lit(1), n).alias("g"), F.slice(x["gaps"], F.lit(2), n).alias("h"))
        blocks = lambda pairs: F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))
        sizes = lambda y: F.transform(y, lambda block: F.transform(block, lambda p: F.length(p["g"]) + F.length(p["m"])))
        starts = lambda y: F.transform(y["blocks"], lambda block, k: in_block(block, F.get(y["sizes"], k), total(F.slice(y["totals"], F.lit(1), k))))
        summed = lambda y: _let(F.struct(y["blocks"], y["sizes"], F.transform(y["sizes"], total).alias("totals")), starts)
        found = _let(zipped, lambda pairs: _let(blocks(pairs), lambda y: _let(F.struct(y.alias("blocks"), sizes(y).alias("sizes")), summed)))
        return F.when(n > 0, F.flatten(found)).otherwise(F.array().cast(f"array<{_MATCH}>"))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int"))
        ),
    )
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros don't count; what is left must be up to three digits and at most 255
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)


def _passes(kind: str):
    return lambda x: _valid(kind, x["m"])


def _wider(kind: str):
    """Which matches of the base and the wider pattern are the wider one's; a secret has letters and digits, or capitals only."""
    if kind in BASE:
        return lambda x: ~x["m"].rlike(f"^(?:{BASE[kind]})$")
    return lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") | x["m"].rlike("^[A-Z]{16,}$")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "1").when(no, "-1").otherwise("0")


def _shape(kind: str, m: Column) -> Column:
    """The regex labeler: does the span alone look like the kind?"""
    if kind == "email":
        return _vote(m.rlike(r"^[A-Za-z][A-Za-z0-9._+-]*+(?:@| ?[\(\[])"), m.rlike(r"^[^A-Za-z]|\.\.|[0-9]$"))
    if kind == "ip":
        return _vote(m.rlike(r"^(?:[1-9][0-9]{0,2}\.)(?:[0-9]{1,3}\.){2}[0-9]{1,3}$") & m.rlike("[0-9]{2}"), m.rlike(r"^(?:[0-9]\.){3}[0-9]$|(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(m.rlike(r"^(?:[0-9]{4}[ -]){3}[0-9]{1,7}$|^[0-9]{15,16}$"), m.rlike(r"[ -].?[ -]|^([0-9])\1+$"))
    if kind == "phone":
        return _vote(m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}$|^\+[0-9]{1,3}[ (].*[ -][0-9]{3,}$"), m.rlike(r"\.[0-9]+\.|^[0-9]{3} [0-9]{3} [0-9]{4}$|0000"))
    return _vote(m.rlike(r"^[A-Z]{4}[0-9A-Z]{16}$|^[0-9a-f]{16,}$|^[a-z]{2,4}[_-][A-Za-z0-9]{20,}$|^[A-Za-z0-9+/]{32,}=*$"), m.rlike(r"^[A-Za-z_/-]+[0-9]{1,4}$|^[0-9]{1,4}[A-Za-z_/-]+$|[-_/].*[-_/].*[-_/]"))


def _listed(kind: str, x: Column) -> Column:
    """The gazetteer labeler: is a part of the span, or what it is the value of, on a list?"""
    m = x["m"]
    if kind == "email":
        ends = F.lower(m).rlike(rf"[^a-z0-9](?:{'|'.join(ENDINGS)})$")
        return _vote(ends, ~ends & m.rlike(r"[^A-Za-z0-9][A-Za-z0-9-]$"))
    if kind == "ip":
        return _vote(~m.rlike(r"^(?:0|10|127|169|192|2[2-5][0-9])\."), m.rlike(r"^(?:0|127|2[4-5][0-9])\."))
    if kind == "card":
        known = _digits(m).rlike(r"^(?:4[0-9]{15}$|5[1-5][0-9]{14}$|2[2-7][0-9]{14}$|3[47][0-9]{13}$|6011[0-9]{12}$|65[0-9]{14}$)")
        return _vote(known, ~known)
    if kind == "phone":
        known = m.rlike(rf"^\+(?:{'|'.join(CALLING)})(?![0-9]{{12}})") | ~F.startswith(m, F.lit("+")) & m.rlike(r"^\(?[2-9][0-8][0-9]")
        return _vote(known, m.rlike(r"^\+0|^\(?[01]"))
    key = F.lower(x["before"]).rlike(rf"(?:^|[^a-z])(?:{'|'.join(KEYS)})s?[\"']?\s{{0,3}}[=:]?\s{{0,3}}[\"']?$")
    return _vote(key | m.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-)"), F.lower(x["before"]).rlike(r"[/#?&.]$"))


def _around(kind: str, x: Column) -> Column:
    """The context labeler: words near the span."""
    near = F.lower(F.concat(x["before"], F.lit(" ␟ "), x["after"]))
    return _vote(near.rlike(rf"(?:^|[^a-z])(?:{'|'.join(NEAR[kind])})(?:[^a-z]|$)"), near.rlike(rf"(?:^|[^a-z])(?:{'|'.join(FAR[kind])})(?:[^a-z]|$)"))


def _features(kind: str, x: Column) -> Column:
    """What the classifier sees, as words: the span's length, share of digits, letters and joints, and its neighbours."""
    m, n, d = x["m"], F.length(x["m"]), F.length(_digits(x["m"]))
    size = F.when(n < 12, "short").when(n < 16, "middle").when(n < 24, "long").otherwise("longer")
    digits = F.when(d == 0, "none").when(d * 5 < n, "few").when(d * 5 < n * 4, "some").otherwise("most")
    letters = F.when(m.rlike("[a-z]"), F.when(m.rlike("[A-Z]"), "mixed").otherwise("lower")).when(m.rlike("[A-Z]"), "upper").otherwise("no")
    joints = F.when(m.rlike(r"[\(\[]"), "bracket").when(m.rlike("[-_/]"), "joint").when(m.rlike("[ ]"), "space").otherwise("plain")
    before = F.when(x["before"].rlike(r"[=:\"']\s?$"), "assigned").when((x["before"] == "") | x["before"].rlike(r"\s$"), "apart").otherwise("attached")
    return F.concat_ws(" ", F.lit(kind), size, digits, letters, joints, before)


_SPAN = "array<struct<pos:int,kind:int,end:int,base:boolean,votes:string,key:string>>"


def _voted(kind: str, number: int, spans: Column, base: bool) -> Column:
    """array<struct<pos, kind, end, base, votes, key>>; votes: the labelers', key: the classifier's features."""

    def one(x: Column) -> Column:
        votes = F.concat_ws(" ", F.lit(kind), _shape(kind, x["m"]), _listed(kind, x), _around(kind, x))
        return F.struct(x["pos"].cast("int").alias("pos"), F.lit(number).alias("kind"), (x["pos"] + F.length(x["m"])).cast("int").alias("end"), F.lit(base).alias("base"), votes.alias("votes"), _features(kind, x).alias("key"))

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """Base spans and wider candidates of a text, with the labelers' votes and the classifier's features."""
    parts = []
    for k, kind in enumerate(KINDS):
        found = []
        if kind in BASE:
            found.append(_voted(kind, k, F.filter(_matches(text, BASE[kind]), _passes(kind)), True))
        if kind in WIDE:
            both = f"{BASE[kind]}|{WIDE[kind]}" if kind in BASE else WIDE[kind]  # what a base pattern takes isn't searched again
            found.append(_voted(kind, k, F.filter(_matches(text, both), _wider(kind)), False))
        parts.append(F.when(text.rlike(_MAY[kind]), F.concat(*found)).otherwise(F.array().cast(_SPAN)).cast(_SPAN))
    return F.concat(*parts)


def expectation_maximisation(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """P(span is personal) by vote pattern (kind and votes): a prior by kind, and for each kind's labelers how they vote on
    true and false spans. They start out a little better than chance; votes of 0 abstain and tell what they tell."""
    post: dict[str, float] = {}
    for kind in {k.split(" ")[0] for k in counts}:
        rows = [([int(v) for v in k.split(" ")[1:]], n, k) for k, n in counts.items() if k.split(" ")[0] == kind]
        prior, width = 0.5, len(rows[0][0])
        says = [[{1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.1, 0: 0.3, -1: 0.6}] for _ in range(width)]
        for _ in range(rounds):
            for votes, _, key in rows:
                t = math.log(prior) + sum(math.log(says[j][0][v]) for j, v in enumerate(votes))
                f = math.log(1 - prior) + sum(math.log(says[j][1][v]) for j, v in enumerate(votes))
                post[key] = 1 / (1 + math.exp(max(-500.0, min(500.0, f - t))))
            prior = (1 + sum(post[key] * n for _, n, key in rows)) / (2 + sum(n for _, n, _ in rows))
            for j in range(width):
                for y in (0, 1):
                    # the start counts as ten candidates, so a labeler that hardly votes keeps its direction
                    weight = {v: 10 * (0.6, 0.3, 0.1)[(1 - v) if y == 0 else (1 + v)] + sum(n * (post[key] if y == 0 else 1 - post[key]) for votes, n, key in rows if votes[j] == v) for v in (1, 0, -1)}
                    total = sum(weight.values())
                    says[j][y] = {v: w / total for v, w in weight.items()}
    return post


def train_classifier(target: dict[str, tuple[float, int]], steps: int = 600, rate: float = 2.0) -> dict[str, float]:
    """The final span classifier: logistic regression on the words of each feature key, within its kind, fitted to the mean
    estimated label of its candidates. ``target``: (label, candidates) by key; out: P by key."""
    words = {k: [f"{k.split(' ')[0]} {j} {w}" for j, w in enumerate(k.split(" "))] for k in target}
    weights = dict.fromkeys((w for own in words.values() for w in own), 0.0)
    totals: dict[str, int] = {}
    for k, (_, n) in target.items():
        totals[k.split(" ")[0]] = totals.get(k.split(" ")[0], 0) + n
    p = dict.fromkeys(target, 0.5)
    for _ in range(steps):
        slope = {w: 0.0005 * x for w, x in weights.items()}
        for k, (label, n) in target.items():
            p[k] = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(weights[w] for w in words[k])))))
            for w in words[k]:
                slope[w] += n / totals[k.split(" ")[0]] * (p[k] - label)
        for w, g in slope.items():
            weights[w] -= rate * g
    return p


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of kind, start, end, sorted; code points, end exclusive).

    Base spans always stay. Wider candidates (obfuscated addresses, numbers without a calling code, and keys and passwords,
    kind ``secret``) become spans when the classifier, trained on labels that expectation-maximisation estimates from the
    votes of all candidates of the table, is ``CONFIDENT``. Null text is empty and has no spans; a text of any length, with
    any number of matches, is scanned whole in linear time; repeated rows and null ids are kept; an empty table trains
    nothing and gives an empty result; other columns are ignored.
    """
    found = stash(docs.select(F.col(id_col).alias("doc_id"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("found")), "pii-candidates")
    # at most 27 votes x 4 * 4 * 4 * 4 * 3 features of each kind, whatever the input
    seen = found.select(F.explode("found").alias("x")).groupBy("x.votes", "x.key").agg(F.count(F.lit(1)).alias("n")).collect()
    votes: dict[str, int] = {}
    for r in seen:
        votes[r["votes"]] = votes.get(r["votes"], 0) + r["n"]
    label = expectation_maximisation(votes)
    sums: dict[str, tuple[float, int]] = {}
    for r in seen:
        total, n = sums.get(r["key"], (0.0, 0))
        sums[r["key"]] = total + label[r["votes"]] * r["n"], n + r["n"]
    p = train_classifier({k: (total / n, n) for k, (total, n) in sums.items()})
    sure = [k for k, v in p.items() if v >= CONFIDENT]
    chosen = F.filter("found", lambda x: x["base"] | x["key"].isin(sure)) if sure else F.filter("found", lambda x: x["base"])

    def named(spans: Column) -> Column:
        kinds = F.array(*(F.lit(k) for k in KINDS))
        return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["pos"], x["kind"], x["end"]))), lambda x: F.struct(F.get(kinds, x["kind"]).alias("kind"), x["pos"].alias("start"), x["end"].alias("end")))

    return found.select("doc_id", named(F.filter("found", lambda x: x["base"])).alias("base"), named(chosen).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans as text, how many are added, and
    whether there is any."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = (F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS if k in BASE)
    more = ((F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size(F.filter("spans", _is("secret"))).cast("long").alias("n_secret"), (F.size("spans") > 0).alias("personal"))
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)
