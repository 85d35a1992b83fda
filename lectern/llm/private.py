"""Personal data: validated base spans, and candidates selected by gradient boosting.  DataFrame functions only.

Base spans (email, ip, card, phone) are the contract's patterns with their checks and always stay.
High-recall generators propose further spans, which may overlap: disguised addresses, numbers in
other notations, IPv6, identity numbers, tokens, keys, key blocks and values behind a cue such as
``password:``.  They set no upper length where the kind has none.  Boosted trees score format and
context features of each candidate; every kind has a threshold calibrated to PRECISION on examples
held out from fitting.

Of overlapping spans the base ones stay, then the higher score to one decimal, then the longer one
(ties: kind, start, end): spans are taken in that order, and a candidate falls only to a span that
was itself kept.

The trees are fitted on EXAMPLES generated sentences (fixed seed), whose features the same
columns compute as on documents; that table's size is the bound of what goes to the driver.

Patterns are written so that a search is linear in the text: runs are entered at their start only
and not given back.  Cases: null is the empty text without spans; ties in start are ordered by
kind; repeated rows give the same spans; an empty table gives no rows; input columns are kept in a
struct and clash with nothing.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boosting
from lectern.llm.common import let, session, staged, table, unpacked

KINDS = ("email", "ip", "card", "phone", "id", "secret")
EXAMPLES, PRECISION, SEED = 9600, 0.99, 11
_BLOCK = 64
#: Number of features of a candidate.
WIDTH = 40

#: The base patterns, in forms that match the same text without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_CUED = r"passwords?|passwort|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer"
#: (kind, pattern, what a text must have for the pattern to be tried).
GENERATORS = [
    (
        "email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?(?:\(at\)|\[at\]|\{at\}|(?<= )at |@) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot ) ?|\.)[A-Za-z0-9-]++)++",
        r"@|[(\[{]at[)\]}]| at ",
    ),
    (
        "ip",
        r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3})(?![0-9A-Za-z:])",
        r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:|[0-9][\[(]",
    ),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])", "[0-9][ ._/-]{0,2}[0-9]"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:(?:00|\+)[ -]?[0-9]{1,3}[ -]?)?\(?[0-9]{2,4}\)?[ ./-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])", "[0-9]{2}[ .-][0-9]{2}"),
    ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}|[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){3,7}(?:[ -]?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])", "[0-9]{2}"),
    ("secret", r"(?<![A-Za-z0-9_/+=.-])(?=[A-Za-z0-9_/+=.-]{16})[A-Za-z0-9_/+=.-]*[A-Za-z0-9_=]", "[A-Za-z0-9_/+=.-]{16}"),
    ("secret", r"(?i)(?<=[:=][ ]{0,1}[\"']{0,1})(?<=(?:" + _CUED + r")[\"']{0,1}[ ]{0,1}[:=][ ]{0,1}[\"']{0,1})[^\s\"'<>]{6,}+", "(?i)(?:" + _CUED + r")[\"']? ?[:=]"),
    ("secret", r"-----BEGIN [A-Z ]*+-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]*+-----)?+", "-----BEGIN "),
]
#: What a text must have for a pattern to be tried.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Words before a span that speak for or against its kind.
_CUES = {
    "email": r"(?i)mail|contact|write|reach|address|kontakt|correo",
    "ip": r"(?i)\bip\b|host|server|address|login|client|ssh|ping",
    "card": r"(?i)card|visa|master|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell|whatsapp|ring|dial|reach|sms|text",
    "id": r"(?i)ssn|social|iban|account|passport|\bid\b|konto|compte|security",
    "secret": r"(?i)token|key|secret|passw|pwd|bearer|auth|api|credential|login",
}
_AGAINST = r"(?i)isbn|order|version|page|\bno\b|nr|chapter|volume|invoice|#|figure|table|part|ref|article|hash|commit|doi|model|serial|checksum|digest|build|file|url|path|at [0-9: ]*$"
_DOMAINS = r"(?i)(?:\.|dot[)\]}]?|\)|\]) ?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example|test)$"


def _sums(lengths: Column) -> Column:
    """Sums before each element, in blocks: linear for all but giant arrays."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    before = let(blocks, lambda bs: F.transform(bs, lambda _, b: add(F.slice(bs, 1, b))))
    each = lambda pre: F.transform(lengths, lambda _, i: pre[F.floor(i / _BLOCK).cast("int")] + add(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))
    return let(before, each)


_MATCH = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches, leftmost and non-overlapping: start, end (code points), match, text before and after."""

    def spans(found: Column) -> Column:
        def place(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m))

            def each(sums: Column) -> Column:
                return F.transform(
                    found,
                    lambda m, i: F.struct(
                        (sums[i] + F.length(gaps[i])).alias("s"),
                        (sums[i] + F.length(gaps[i]) + F.length(m)).alias("e"),
                        m.alias("m"),
                        F.right(gaps[i], F.lit(24)).alias("before"),
                        F.left(gaps[i + 1], F.lit(8)).alias("after"),
                    ),
                )

            return let(let(steps, _sums), each)

        return F.when(F.size(found) == 0, F.array().cast(_MATCH)).otherwise(let(F.split(text, pattern, -1), place))

    return F.when(~text.rlike(needs), F.array().cast(_MATCH)).otherwise(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    worth = F.transform(turned, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: _octets(x["m"]),
    "card": lambda x: let(_digits(x["m"]), lambda d: F.length(d).between(14, 19) & luhn(d)),
    "phone": lambda x: let(_digits(x["m"]), lambda d: F.length(d).between(10, 15)),
}


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of the base kinds, by start and kind."""
    each = lambda k, kind: F.transform(F.filter(matches(text, BASE[kind], _NEEDS[kind]), _VALID[kind]), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    return F.sort_array(F.concat(*[each(k, kind) for k, kind in enumerate(BASE)]))


def features(kind: str, x: Column) -> list[Column]:
    """Format and context of a candidate, as WIDTH doubles."""
    m, before, after = x["m"], x["before"], x["after"]
    count = lambda pattern: (F.length(m) - F.length(F.regexp_replace(m, pattern, ""))).cast("double")
    share = lambda pattern: count(pattern) / F.length(m)
    turns = (F.length(F.regexp_replace(m, "(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z0-9])", "~")) - F.length(m)).cast("double")
    digits = _digits(m)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        *[F.lit(float(kind == k)) for k in KINDS],
        F.length(m).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[ ]"), count("[-./_:]"), count("[()\\[\\]{}]"),
        share("[0-9a-f]"), F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        flag((F.length(digits) > 11) & luhn(digits)), flag(m.rlike(_DOMAINS)), flag(m.rlike(r"[(\[{]at[)\]}]")), flag(m.rlike("@")), flag(m.rlike(r" dot |[(\[{]dot[)\]}]")),
        flag(m.rlike(r"\. [A-Z]")), flag(before.rlike(_CUES[kind])), flag(before.rlike(_AGAINST)), flag(before.rlike(r"[0-9] ?$")), flag(after.rlike(r"^ ?[0-9%]")), flag(before.rlike(r"[=:\"'] ?$")),
        flag(m.rlike(r"^(?:19|20)[0-9]{2}[-./]")), flag(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        turns / F.length(m), share("[0-9]"), share("[AEIOUaeiou]"), count("[/+=]"), flag(m.rlike("::")), flag(m.rlike("[a-z]{7,}|[A-Z]{2,}[a-z]{5,}")),
        flag(m.rlike(r"^(?:eyJ|[a-z]{2,5}_|AKIA|AIza|xox|sk-|pk-|-----BEGIN)")), flag(m.rlike(r"://|^www\.|^/|\.(?:com|org|net|html?|pdf|py|txt|js|md|jpe?g|png|csv|json|xml|gz|zip)\b")),
        flag(before.rlike("(?i)(?:" + _CUED + r")[\"']? ?[:=] ?[\"']?$")), flag(m.rlike("[^A-Za-z0-9_/+=.-]")), flag(m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")), count("[.]"),
    ]


def _candidates(text: Column, kind: str) -> Column:
    """array<struct<s, e, f>> of all generators of a kind; spans may overlap and repeat."""
    found = [F.transform(matches(text, pattern, needs), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*features(kind, x)).alias("f"))) for k, pattern, needs in GENERATORS if k == kind]
    return found[0] if len(found) == 1 else F.concat(*found)


_PLAIN = "time year people way day thing world life hand part child place work week case point company number group problem fact house water room area money story month book eye job word business issue side kind head service friend father power hour game line end member law car city name team minute idea body level door health person art war history party result change morning reason research girl guy moment air teacher force haus zeit jahr tag mann frau kind weg leben welt maison temps jour homme femme vie monde casa tiempo hombre mujer vida mundo trabajo".split()


def _examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(kind, sentence, label): sentences with one span of private data, and with look-alikes."""
    import random

    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllables = lambda: "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "l"]) for _ in range(r.randint(1, 4)))
    word = lambda: r.choice(_PLAIN) if r.random() < 0.6 else syllables()
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))

    def card(valid: bool) -> str:
        body = d(15)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(body))
        last = (10 - total % 10) % 10
        return body + str(last if valid else (last + r.randint(1, 9)) % 10)

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    tld = lambda: r.choice(["com", "org", "net", "io", "de", "fr", "es", "edu", "co.uk"])
    pair = r.choice
    at, dot = lambda: pair(["(at)", "[at]", " (at) ", " [at] ", " at ", " @ ", "{at}"]), lambda: pair(["(dot)", "[dot]", " [dot] ", " dot ", ".", "."])
    cue = {"email": ["mail", "contact", "write to", "reach me:"], "ip": ["server", "host", "ip", "login from", "ping"], "card": ["card", "visa", "pay with"], "phone": ["call", "tel", "phone", "mobile", "fax:"], "id": ["ssn", "iban", "account", "social security"], "secret": ["token =", "api key:", "secret:", "password =", "Bearer", "auth token", "access key"]}
    anti = ["order no", "isbn", "page", "version", "invoice", "figure", "ref", "article", "commit hash", "serial", "file", "build", "checksum", "url"]
    drawn = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    lower, upper, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, keys, wide = lambda k: drawn("0123456789abcdef", k), lambda k: drawn(lower + upper + number, k), lambda k: drawn(lower + upper + number + "+/", k)
    jwt = lambda: f"eyJ{keys(r.randint(15, 40))}.eyJ{keys(r.randint(20, 160))}.{drawn(lower + upper + number + '_-', r.randint(27, 86))}"
    block = lambda: f"-----BEGIN {pair(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n" + "\n".join(wide(r.choice([24, 40, 64, 64])) for _ in range(r.randint(1, 6))) + "\n-----END PRIVATE KEY-----"
    chosen = lambda: pair([word().title(), keys(4), syllables()]) + pair(["", "&", "!", "#", "$", "_", "-", ".", "@"]) + keys(r.randint(2, 8)) + d(r.randint(1, 4)) + pair(["", "!", "?", "#"])
    ip6 = lambda: pair([":".join(hexes(4) for _ in range(8)), "2001:db8::" + hexes(r.randint(1, 4)), "fe80::" + ":".join(hexes(r.randint(1, 4)) for _ in range(r.randint(1, 4))), ":".join(hexes(r.randint(1, 4)) for _ in range(r.randint(2, 4))) + "::" + hexes(r.randint(1, 4))])
    good = {
        "email": lambda: f"{word()}{pair(['', '.', '_'])}{word()}{d(r.randint(0, 2))}{at()}{word()}{dot()}{tld()}",
        "ip": lambda: ip6() if r.random() < 0.6 else pair(["[.]", "(.)", "[dot]"]).join(str(r.randint(1, 254)) for _ in range(4)),
        "card": lambda: grouped(card(True), pair([".", "/", "--", "  ", "_"])),
        "phone": lambda: pair([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0049 {d(3)} {d(4)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(3)} {d(2)} {d(2)}"]),
        "id": lambda: pair([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{pair(['DE', 'FR', 'ES', 'GB', 'NL', 'CH'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"DE{d(20)}", f"GB{d(2)}{drawn(upper, 4)}{d(14)}", f"NL{d(2)} {drawn(upper, 4)} {d(4)} {d(4)} {d(2)}"]),
        "secret": lambda: pair([hexes(32), hexes(40), hexes(64), hexes(r.randint(70, 400)), keys(20), keys(24), keys(32), wide(40), wide(43) + "=", wide(86) + "==", wide(r.randint(100, 500)), "sk_live_" + keys(24), "sk-" + keys(40), "ghp_" + keys(36), "xoxb-" + d(11) + "-" + keys(24), "AKIA" + drawn(upper + number, 16), drawn(upper + number, r.randint(18, 32)), jwt(), jwt(), block(), block(), block()]),
    }
    names = lambda k, sep: sep.join(word() for _ in range(k))
    bad = {
        "email": lambda: pair([f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{tld().title()}", f"{word()}. {word()} at {word()}.{word().title()}", f"{word()} at the {word()}. {word()}"]),
        "ip": lambda: pair([f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}:{d(1)}:{d(2)}:{d(2)}", f"{d(1)}:{d(1)}:{d(1)}", f"{d(2)}::{d(2)}"]),
        "card": lambda: pair([card(False), grouped(card(False), pair(["-", ".", " "])), d(13), f"{d(4)} {d(4)} {d(4)} {d(3)}"]),
        "phone": lambda: pair([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"97{pair('89')}-{d(2)}-{d(4)}-{d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{r.randint(1900, 1999)} {r.randint(1900, 1999)} {r.randint(2000, 2030)}"]),
        "id": lambda: pair([f"{pair(['AB', 'XZ', 'PQ'])}{d(2)} {keys(4).upper()} {word()[:4].upper():X<4} {keys(4).upper()} ZZZZ", f"{d(3)} {d(2)} {r.randint(1900, 2030)}"]),
        "secret": lambda: pair([
            (word() + word() + word() + word() + word())[:30] + d(1), names(5, "_") + "_" + d(1), names(5, "-") + "-" + d(2), names(4, "/"), names(4, "."), "www." + names(2, "") + ".com/" + names(3, "/"), names(4, "/") + ".html", "/".join(["", "usr", "local", *[word() for _ in range(3)]]) + ".py",
            names(3, "-") + "-" + d(4) + "-" + d(2) + "-" + d(2), f"{d(4)}-{d(2)}-{d(2)}T{d(2)}", "".join(word().title() for _ in range(r.randint(4, 7))), d(20), "=" * 20 + d(1), "-" * 24 + d(1), "." * r.randint(16, 40) + d(2), names(6, "..."), "_" * 20, f"{word()}.{word()}.{word()}.{d(1)}.{d(1)}.{d(2)}",
        ]),
    }
    out = []
    for i in range(n):
        kind, label = KINDS[i % len(KINDS)], int(r.random() < 0.5)
        lead = r.choice(cue[kind]) if r.random() < (0.6 if label else 0.15) else r.choice(anti) if r.random() < (0.02 if label else 0.5) else word()
        if kind == "secret" and r.random() < 0.25:  # a value behind its cue
            lead = pair(["password:", "Password: ", "passwd=", "secret=", "token:", "api_key=", "pwd: "])
            out.append((kind, f"{prose()} {lead}{pair(['', ' '])}{chosen() if label else pair(['required', 'incorrect', 'protected', syllables() + syllables() + syllables(), 'changed.'])} {prose()}", label))
            continue
        body = good[kind]() if label else bad[kind]()
        quote = '"' if kind == "secret" and r.random() < 0.4 else ""
        out.append((kind, f"{prose()} {lead} {quote}{body}{quote}{pair(['', '', '.', ','])} {prose()}", label))
    return out


@lru_cache(maxsize=1)
def _fitted(spark: SparkSession) -> tuple[list, dict[str, float]]:
    import numpy as np

    made = staged(spark.createDataFrame(_examples(), "kind string, text string, label int").coalesce(1))
    found = None
    for kind in KINDS:
        of = made.where(F.col("kind") == kind).select("kind", "label", F.xxhash64("text").alias("h"), F.explode(_candidates(F.col("text"), kind)).alias("c"))
        found = of if found is None else found.union(of)
    data = sorted((r["h"], r["kind"], r["label"], tuple(r["f"])) for r in found.select("h", "kind", "label", "c.f").collect())  # a few candidates an example
    x, y = np.array([r[3] for r in data]), np.array([r[2] for r in data])
    fold = np.arange(len(data)) % 3 == 0
    trees = boosting.fit(x[~fold], y[~fold])
    scores, kinds = boosting.predict(trees, x), np.array([r[1] for r in data])
    return trees, {k: max(0.5, boosting.threshold(scores[fold & (kinds == k)], y[fold & (kinds == k)], PRECISION)) for k in KINDS}


_RANKED = "array<struct<q:double,n:int,k:int,s:int,e:int>>"


def _greedy(run: Column) -> Column:
    """Of overlapping spans: in their order, each that overlaps none kept before it; all with q = -2."""
    overlaps = lambda kept, x: F.exists(kept, lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"]))
    take = lambda kept, x: F.when((x["q"] == -2.0) | ~overlaps(kept, x), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(F.sort_array(run), F.array().cast(_RANKED), take)


def settled(spans: Column) -> Column:
    """array<struct<s, k, e>> that stay of array<struct<s, k, e, p>>, sorted by s: cut to runs that touch no other, then greedily."""

    def runs(all_: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(starts, lambda a, i: F.slice(all_, a + 1, F.coalesce(F.get(starts, i + 1), F.size(all_)) - a))

        def begins(reach: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.coalesce(F.get(all_, i)["s"] >= F.get(reach, i - 1), F.lit(True)))

        parts = let(let(_reach(all_), begins), cut)
        ranked = lambda run: F.transform(run, lambda x: F.struct((-F.round(x["p"], 1)).alias("q"), (x["s"] - x["e"]).alias("n"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
        best = F.flatten(F.transform(parts, lambda run: F.when(F.size(run) == 1, ranked(run)).otherwise(_greedy(ranked(run)))))
        return F.sort_array(F.transform(best, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return F.when(F.size(spans) == 0, none).otherwise(let(spans, runs))


def selected_spans(text: Column, base: Column, spark: SparkSession) -> Column:
    """array<struct<s, k, e>>: the base spans and the candidates that the trees select."""
    trees, limits = _fitted(spark)
    scored = [_scored(text, kind, k, trees, limits[kind]) for k, kind in enumerate(KINDS)]
    certain = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(2.0).alias("p")))
    return settled(let(F.sort_array(F.concat(certain, *scored)), lambda x: x))


def _scored(text: Column, kind: str, k: int, trees: list, limit: float) -> Column:
    score = lambda c: boosting.expression(trees, [c["f"][i] for i in range(WIDTH)])
    rated = F.transform(_candidates(text, kind), lambda c: F.struct(c["s"].alias("s"), F.lit(k).alias("k"), c["e"].alias("e"), score(c).alias("p")))
    return F.filter(rated, lambda c: c["p"] >= limit)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """(r, doc_id, text, base, spans): the input row as a struct, and its spans as array<struct<s, k, e>>."""
    spark = session(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    return rows.withColumn("base", base_spans(text)).withColumn("spans", selected_spans(text, F.col("base"), spark))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap count as one, of the first kind."""
    size = 1024
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    last = lambda a: F.get(a, F.size(a) - 1)

    def joined(pieces: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(b / size).cast("int") - first + 1), "")
            return F.when(a >= b, F.lit("")).otherwise(F.substring(some, a - first * size + 1, b - a))

        def whole(reach: Column) -> Column:
            starts = F.filter(F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("r"))), lambda x: (x["s"] >= x["r"]))
            parts = F.transform(starts, lambda x: F.concat(cut(x["r"], x["s"]), names[x["k"]]))
            return F.concat(F.array_join(parts, ""), cut(last(reach), F.length(text)))

        return let(_reach(spans), whole)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), joined))


def _reach(spans: Column) -> Column:
    """Greatest end of each span and those before it."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    ends = F.transform(spans, lambda x: x["e"])

    def each(es: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), block(F.size(es) - 1)), lambda b: F.array_max(F.slice(es, 1, (b + 1) * _BLOCK)))
        return let(tops, lambda ts: F.transform(es, lambda _, i: F.greatest(F.coalesce(F.get(ts, block(i) - 1), F.lit(0)), F.array_max(F.slice(es, block(i) * _BLOCK + 1, i % _BLOCK + 1)))))

    return let(ends, each)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; n_chars follows."""
    rows = found_spans(docs).withColumn("new", redacted(F.coalesce("text", F.lit("")), F.col("spans")))
    return unpacked(rows, docs.columns, F.when(F.col("text").isNotNull(), F.col("new")))


def query(spark, sf_dir: str) -> DataFrame:
    rows = found_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
