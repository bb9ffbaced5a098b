"""Personal data: high-recall candidate spans, boosted trees over format and context, calibrated thresholds.

Generators propose spans: the strict patterns of each kind and looser ones around them, for credentials too. Every
candidate becomes a few discrete features of its format and its surroundings. The trees are fitted on generated texts
that state which of their spans are personal data (``examples``): obfuscated, national and mistyped forms among them,
and dates, versions, article numbers, checksums and the like against them. A part of these texts is held out and sets a
threshold for each kind. Strict finds always stay; of the rest, spans that reach their threshold are added. Only
DataFrame functions touch the texts.
"""

from __future__ import annotations

import math
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of the results: credentials come from the method alone.
ALL_KINDS = (*KINDS, "secret")
# The strict patterns. A repeated part takes all it can and never gives back, and a match begins where a
# run of its letters begins or the last match ended, so a text is read once.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]++(?<=[0-9])|\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms of the same kinds, and of credentials.
LOOSE = {
    "email": r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9._%+-]++){0,2}+(?:\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?i)(?:(?<![0-9A-Za-z:])|\G)[0-9a-f]{1,4}+(?::[0-9a-f]{0,4}+){5,7}+",
    "card": r"[0-9]{4}(?:[._/\x20-]{1,2}+[0-9]{4,6}+){2,4}+",
    "phone": r"(?:(?<![0-9+])|\G)[(]?[0-9]{2,4}+[)]?(?:[\x20./-]{1,2}+[(]?[0-9]{2,4}+[)]?){2,5}+",
    "secret": r"(?<![\p{L}\p{N}_.@/+-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{10,}+={0,2}+",
}
#: Characters kept on either side of a candidate as its context.
CONTEXT = 24
#: What a text must hold for a pattern to be worth running.
_HINT = {"email": r"(?i)@|\(at\)|\[at\]|\x20at\x20", "ip": r"[0-9]\.[0-9]++\.[0-9]|[0-9a-fA-F]:[0-9a-fA-F]*:", "card": r"[0-9][\x20._/-]*[0-9]", "phone": r"[0-9][\x20()./+-]*[0-9]", "secret": r"[A-Za-z_+/-][0-9]|[0-9][A-Za-z]"}


def found_by(text: Column, pattern: str, hint: str) -> Column:
    """The matches of a pattern, leftmost first: characters since the last one, the match, and context on both sides."""
    # Arrays are zipped, not looked up by place: an expression inside a lambda would be computed for every match.
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sides = F.zip_with(gaps, F.slice(F.split(text, pattern, -1), 2, F.lit(2**31 - 1)), lambda g, n: F.struct(g.alias("gap"), F.left(n, F.lit(CONTEXT)).alias("after")))
    span = lambda m, s: F.struct(F.length(s["gap"]).alias("gap"), F.octet_length(s["gap"]).alias("gap_bytes"), m.alias("match"), F.right(s["gap"], F.lit(CONTEXT)).alias("before"), s["after"].alias("after"))
    made = F.filter(F.zip_with(matches, sides, span), lambda s: s["match"].isNotNull())
    none = F.array().cast("array<struct<gap:int,gap_bytes:int,match:string,before:string,after:string>>")
    return F.when(text.rlike(hint), made).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the check digit."""
    backwards = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return F.length(digits).between(1, 19) & (total % 10 == 0)


def _valid(kind: Column, match: Column) -> Column:
    """Whether a strict match holds: parts of an address at most 255, 13 to 19 digits and Luhn, 9 to 15 digits."""
    digits = _digits(match)
    small = match.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.|$)){4}$")
    return (kind == "email") | ((kind == "ip") & small) | ((kind == "card") & F.length(digits).between(13, 19) & F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)) | ((kind == "phone") & F.length(digits).between(9, 15))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (rid, row), and their candidate spans: rid, kind, strict, begin, end, first_byte, last_byte,
    match, before, after.

    begin and end are code points, the bytes are those of UTF-8; ends are exclusive. Overlapping spans of several generators all stay. Null text has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), found_by(text, pattern, _HINT[kind]).alias("spans")) for patterns, strict in ((STRICT, True), (LOOSE, False)) for kind, pattern in patterns.items()]
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row"), F.filter(F.array(*found), lambda f: F.size(f["spans"]) > 0).alias("found")), "pii_rows")
    each = rows.select("rid", F.explode("found").alias("f")).select("rid", "f.kind", "f.strict", F.posexplode("f.spans").alias("at", "s"))
    so_far = Window.partitionBy("rid", "kind", "strict").orderBy("at")
    end, last = F.sum(F.col("s.gap") + F.length("s.match")).over(so_far), F.sum(F.col("s.gap_bytes") + F.octet_length("s.match")).over(so_far)
    placed = each.withColumn("end", end.cast("int")).withColumn("last_byte", last.cast("int"))
    placed = placed.select("rid", "kind", "strict", (F.col("end") - F.length("s.match")).alias("begin"), "end", (F.col("last_byte") - F.octet_length("s.match")).alias("first_byte"), "last_byte", "s.match", "s.before", "s.after")
    return rows.select("rid", "row"), placed


FEATURES = ("kind", "strict", "digits", "groups", "luhn", "plus", "parens", "cue", "boundary", "lead", "holds", "style", "length", "turns", "letters")
# Words that announce each kind, or something else, in the order that decides.
CUES = {
    "secret": r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|key|bearer|auth|credential|login)",
    "card": r"(?:card|visa|mastercard|amex|credit|debit|cvv)",
    "phone": r"(?:tel|phone|call|mobile|fax|whatsapp|cell|ring)",
    "email": r"(?:e?-?mail|contact|write|reach)",
    "ip": r"(?:ip|host|server|address|node|gateway)",
    "other": r"(?:commit|sha1?|sha256|md5|hash|checksum|uuid|guid|version|build|release|isbn|issn|order|invoice|article|item|part|serial|model|ref|page|pages|date|on|from|until|score|section|file|img)",
}


def _first(*cases: tuple[Column, int], otherwise: int = 0) -> Column:
    out = F.lit(otherwise)
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def features(spans: DataFrame) -> DataFrame:
    """``spans`` with the discrete features, each an int of a few values, and whether the strict rules accept them."""
    match, kind = F.col("match"), F.col("kind")
    plain = _digits(match)
    digits, size = F.length(plain), F.length(match)
    bucket = _first((digits < 4, 0), (digits < 7, 1), (digits < 9, 2), (digits < 12, 3), (digits < 13, 4), (digits < 16, 5), (digits < 17, 6), (digits < 20, 7), otherwise=8)
    close, near = F.lower(F.right("before", F.lit(14))), F.lower(F.concat_ws(" ", "before", "after"))
    named = list(CUES.values())
    cue = _first(*[(close.rlike(rf"\b\w{{0,8}}?{c}[a-z]{{0,3}}\b\W{{0,5}}$"), k + 1) for k, c in enumerate(named)], *[(near.rlike(rf"\b{c}\b"), len(named) + k + 1) for k, c in enumerate(named[:-1])])
    boundary = F.when(F.col("before").rlike(r"[\p{L}\p{N}_.%+/@-]$"), 1).otherwise(0) + F.when(F.col("after").rlike(r"^[\p{L}\p{N}_%+/@-]|^\.\p{L}|^\.\p{N}"), 2).otherwise(0)
    holds = _valid(kind, match)
    style = _first(
        ((kind == "email") & match.rlike(r"(?i)[(\[](?:at|dot)[)\]]"), 1), ((kind == "email") & match.rlike(r"(?i) dot "), 2), (kind == "email", 3),
        ((kind == "ip") & match.contains("::"), 1), ((kind == "ip") & match.rlike("^(?:[0-9A-Fa-f]{1,2}:){5}[0-9A-Fa-f]{1,2}$"), 2), (kind == "ip", 3),
        ((kind == "secret") & match.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[a-z]-|eyJ|AIza)"), 1), ((kind == "secret") & match.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), 2), ((kind == "secret") & match.rlike("[_/+-]"), 3),
        (match.rlike("[0-9] [0-9]") & match.rlike("[-./_]"), 4), (match.contains("-"), 1), (match.contains("."), 2), (match.rlike("[/_]"), 3), (match.contains(" "), 5),
    )
    length = _first((size < 8, 0), (size < 12, 1), (size < 16, 2), (size < 20, 3), (size < 21, 4), (size < 32, 5), (size < 33, 6), (size < 40, 7), (size < 41, 8), otherwise=9)
    turns = F.least(F.lit(7), F.size(F.regexp_extract_all(match, F.lit("[A-Za-z]+[0-9]|[0-9]+[A-Za-z]"), F.lit(0))))
    letters = _first((~match.rlike("[A-Za-z]"), 0), (match.rlike("^[^g-zA-Z]*$"), 1), (~match.rlike("[A-Z]"), 2), (~match.rlike("[a-z]"), 3), otherwise=4)
    return spans.select(
        *spans.columns,
        (F.col("strict") & holds).alias("base"),
        F.array(
            F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind).cast("int"),
            F.col("strict").cast("int"),
            bucket,
            F.least(F.lit(5), F.size(F.filter(F.split(match, "[^0-9]+"), lambda p: p != ""))),
            F.when(digits <= 19, luhn(plain)).otherwise(False).cast("int"),
            match.startswith("+").cast("int"),
            match.contains("(").cast("int"),
            cue,
            boundary,
            F.when(plain.rlike("^[3-6]"), 1).when(plain.rlike("^(?:19|20)"), 3).when(plain.rlike("^97[89]"), 4).when(plain.rlike("^0"), 5).otherwise(2),
            holds.cast("int"),
            style,
            length,
            turns,
            letters,
        ).alias("f"),
    )


#: Generated texts from which the trees and thresholds are learned; a fifth is held out.
EXAMPLES = 12_000


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[int, str, int, int, str | None]]:
    """Texts with one span each: (number, text, begin, end, its kind or None if it is no personal data)."""
    rng = random.Random(seed)
    pick, num = rng.choice, lambda k, first="0123456789": rng.choice(first) + "".join(rng.choices(string.digits, k=k - 1))
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randrange(2, 10)))
    chars = lambda letters, k: "".join(rng.choices(letters, k=k))
    hexes, mixed, base32 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "234567"

    def checked(digits: int) -> str:
        body = num(digits - 1, "3456")
        for c in string.digits:
            total = sum(sum(divmod(int(d) * (2 if k % 2 else 1), 10)) for k, d in enumerate(reversed(body + c)))
            if total % 10 == 0:
                return body + c
        raise AssertionError

    def grouped(digits: str, sep: str) -> str:
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def mail(at: str, dot: str) -> str:
        local = word() + pick(["", ".", "_", "-", dot if at != "@" else "."]).join(["", pick([word(), num(2), ""])])
        return local + at + dot.join([word() + pick(["", num(1)]), *([word()] if rng.random() < 0.3 else []), pick(["com", "org", "net", "de", "io", "fr", "example"])])

    def six() -> str:
        parts = [chars(hexes, rng.randrange(1, 5)) for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.5 else ":".join([*parts[: rng.randrange(2, 5)], "", *parts[6:]])

    def national() -> str:
        a, b, c = num(3, "23456789"), num(3), num(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(3)}-{num(3)}-{num(3)}", f"(0{num(2)}) {num(4)} {num(4)}"])

    def credential() -> str:
        return pick([
            lambda: "AKIA" + chars(base32, 16), lambda: "ghp_" + chars(mixed, 36), lambda: "sk-" + chars(mixed, pick([32, 40, 48])), lambda: "xoxb-" + num(11) + "-" + chars(mixed, 24),
            lambda: "eyJ" + chars(mixed + "_-", 60), lambda: "AIza" + chars(mixed + "_-", 35), lambda: "sk_live_" + chars(mixed, 24),
        ])()

    def assigned() -> str:
        return pick([lambda: chars(hexes, pick([12, 16, 18, 24, 32, 40, 64])), lambda: chars(mixed, pick([10, 12, 16, 20, 24, 32])), lambda: chars(mixed + "_-+/", pick([20, 40]))])()

    asks = {"email": ["mail", "e-mail:", "contact", "write to", "reach me:"], "ip": ["ip", "host", "server", "address:", "node"], "card": ["card", "visa", "credit card:", "mastercard no.", "card number"], "phone": ["tel.", "phone:", "call", "mobile", "fax"], "secret": ["password=", "token = \"", "secret:", "api_key=", "apikey: ", "access key", "auth_token=", "key ", "pwd=", "passwd: ", "bearer ", "client_secret='"]}
    stray = lambda: pick(asks[pick(list(asks))]).strip("=':").strip() if rng.random() < 0.15 else word()
    made: list[tuple[str | None, str, str]] = []  # kind, cue, value
    for _ in range(n):
        kind = pick(["email", "ip", "card", "phone", "secret", None, None, None, None, None])
        cue = pick(asks[kind]) if kind and rng.random() < 0.5 else ""
        if kind == "email":
            at = pick(["@", " at ", "(at)", " (at) ", "[at]", " [at] "])
            value = mail(at, pick([".", " dot ", "(dot)", "[dot]"]) if at not in (" at ",) or not cue else pick([".", " dot "]))
            if at == " at " and " dot " not in value and not cue:
                kind = None
        elif kind == "ip":
            value = six() if rng.random() < 0.7 else ".".join(str(rng.randrange(256)) for _ in range(4))
        elif kind == "card":
            wrong = rng.random() < 0.25
            value = checked(pick([13, 14, 15, 16, 16, 16, 16, 19]))
            if wrong:  # a mistyped digit: personal only where the text says so
                k = rng.randrange(1, len(value))
                value, cue = value[:k] + str((int(value[k]) + rng.randrange(1, 10)) % 10) + value[k + 1 :], pick(asks["card"])
            value = grouped(value, pick(["", " ", "-", ".", "_", "/"]))
        elif kind == "phone":
            value = national() if rng.random() < 0.7 else f"+{num(2, '123456789')} {num(3)} {num(3)} {num(4)}"
            if not cue and "(" not in value and not value.startswith(("+", "0")) and rng.random() < 0.5:
                cue = pick(asks["phone"])
        elif kind == "secret":
            value = credential() if rng.random() < 0.5 else assigned()
            if not value.startswith(("AKIA", "ghp_", "sk-", "sk_", "xox", "eyJ", "AIza")):
                cue = pick(asks["secret"])
        else:
            cue, value = pick([
                lambda: ("", f"{pick(['19', '20'])}{num(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"), lambda: ("on", f"{rng.randrange(1, 29):02d}.{rng.randrange(1, 13):02d}.20{num(2)}"),
                lambda: ("from", f"{pick(['19', '20'])}{num(2)}-20{num(2)}"), lambda: ("at", f"{rng.randrange(24):02d}:{num(2)}:{num(2)}"), lambda: (pick(["version", "", "build"]), ".".join(num(rng.randrange(1, 4)) for _ in range(3))),
                lambda: (pick(["version", "release", "build"]), f"{num(2)}.{num(1)}.{num(5, '3456789')}.{num(4, '3456789')}"), lambda: (pick(["order", "invoice", "ref", "", "item"]), num(rng.randrange(5, 20))),
                lambda: (pick(["isbn", ""]), f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"), lambda: (pick(["pages", ""]), f"{num(3)}-{num(3)}"), lambda: ("", ".".join([num(1, "123456789"), *[num(3) for _ in range(3)]])),
                lambda: ("", f"{num(2)}.{num(3)}, {num(2)}.{num(3)}"), lambda: (pick(["article", "part", "model", "serial"]), f"{chars(string.ascii_uppercase, 2)}{num(4)}-{num(4)}{chars(string.ascii_uppercase, 2)}"),
                lambda: (pick(["commit", "sha1", "md5", "checksum", "hash", ""]), chars(hexes, pick([32, 40, 40, 64]))), lambda: (pick(["uuid", "guid", ""]), "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))),
                lambda: ("", ":".join(chars(hexes, 2) for _ in range(6))), lambda: (pick(["file", "img", ""]), f"{pick(['IMG', 'scan', 'report', 'DSC'])}_{num(8)}_{num(6)}"), lambda: ("", f"{word()}{num(2)}_{word()}_{word()}"),
                lambda: ("", f"{word()} at {word()}.{pick(['com', 'org', word()])}"), lambda: ("", f"{word()} at {num(2)}.{num(2)}"), lambda: ("", " ".join(num(rng.randrange(1, 5)) for _ in range(rng.randrange(3, 7)))),
                lambda: ("score", "-".join(num(2) for _ in range(4))), lambda: ("", f"{num(4)}/{num(4)}/{num(4)}"), lambda: ("", num(4, "12") + "-" + num(4)), lambda: ("", f"{word()}{num(4)}{word()}{word()}"),
            ])()
        made.append((kind, cue, value))
    out = []
    for k, (kind, cue, value) in enumerate(made):
        lead = " ".join([*(word() for _ in range(rng.randrange(0, 6))), *(f"{stray()} {word()} {word()}" for _ in range(rng.randrange(0, 3)))])
        lead = f"{lead} {cue}".strip()
        lead += "" if not lead or lead[-1] in "='\"" else " "
        tail = pick([" ", ". ", ", ", "\n", '" ' if lead.endswith('"') else " "]) + " ".join([*(stray() for _ in range(rng.randrange(0, 3))), *(word() for _ in range(rng.randrange(0, 5)))])
        out.append((k, lead + value + tail, len(lead), len(lead) + len(value), kind))
    return out


#: Steps from a tree's root to its leaves.
DEPTH = 4


def fit_trees(x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 60, rate: float = 0.3, depth: int = DEPTH, ridge: float = 1.0) -> tuple[float, list]:
    """Gradient boosting with the logistic loss over counted feature vectors: a start value and trees of (feature, most, left, right) or leaf values."""
    prior = float(np.clip(positive.sum() / max(1.0, total.sum()), 1e-4, 1 - 1e-4))
    start = math.log(prior / (1 - prior))
    score, trees = np.full(len(x), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gain_of = lambda a, b: a * a / (b + ridge)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for k in range(x.shape[1]) if left else ():
            values = x[rows, k]
            for most in np.unique(values)[:-1]:
                low = values <= most
                g_low, h_low = g[rows][low].sum(), h[rows][low].sum()
                gain = gain_of(g_low, h_low) + gain_of(sum_g - g_low, sum_h - h_low) - gain_of(sum_g, sum_h)
                if gain > best[0]:
                    best = (gain, k, int(most))
        if best[1] is None:
            return float(-rate * sum_g / (sum_h + ridge))
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    def apply(tree, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(tree, float):
            out[rows] += tree
            return
        low = x[rows, tree[0]] <= tree[1]
        apply(tree[2], rows[low], out)
        apply(tree[3], rows[~low], out)

    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(x)), total * p - positive, total * p * (1 - p), depth)
        trees.append(tree)
        apply(tree, np.arange(len(x)), score)
    return start, trees


def _full(tree, depth: int) -> tuple[list[int], list[int], list[float]]:
    """A tree as inner nodes (feature, most) and leaves of a complete one, in heap order; what is missing goes left."""
    feature, most, leaf = [0] * (2**depth - 1), [2**31 - 1] * (2**depth - 1), [0.0] * 2**depth

    def put(t, at: int) -> None:
        if at >= len(feature):
            leaf[at - len(feature)] = t
        elif isinstance(t, float):
            put(t, 2 * at + 1)
        else:
            feature[at], most[at] = t[0], t[1]
            put(t[2], 2 * at + 1)
            put(t[3], 2 * at + 2)

    put(tree, 0)
    return feature, most, leaf


def trees_column(start: float, trees: list, f: Column, depth: int = DEPTH) -> Column:
    """The probability of a feature vector: each tree is walked from its root in as many steps as it is deep."""
    if not trees:
        return F.lit(1 / (1 + math.exp(-start)))
    array = lambda values: F.array(*map(F.lit, values))
    table = F.array(*[F.struct(array(a).alias("feature"), array(b).alias("most"), array(c).alias("leaf")) for a, b, c in (_full(t, depth) for t in trees)])
    down = lambda t: lambda i, _: 2 * i + 1 + (F.get(f, F.get(t["feature"], i)) > F.get(t["most"], i)).cast("int")
    leaf = lambda t: F.get(t["leaf"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down(t)) - (2**depth - 1))
    return 1 / (1 + F.exp(-F.aggregate(table, F.lit(float(start)), lambda z, t: z + leaf(t))))


def _probabilities(start: float, trees: list, x: np.ndarray) -> np.ndarray:
    def one(tree, row) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([1 / (1 + math.exp(-(start + sum(one(t, row) for t in trees)))) for row in x])


def labelled(spark, texts: list[tuple[int, str, int, int, str | None]]) -> DataFrame:
    """The candidates of ``texts`` with their features, whether their text is held out, and whether they are the
    personal data that it states (up to two characters on either side)."""
    truth = spark.createDataFrame(texts, "doc_id long, text string, begin int, end int, kind string")
    rows, placed = candidates(truth)
    told = rows.select("rid", "row.text", F.col("row.begin").alias("b"), F.col("row.end").alias("e"), F.col("row.kind").alias("is"))
    right = F.col("kind").eqNullSafe(F.col("is")) & (F.abs(F.col("begin") - F.col("b")) <= 2) & (F.abs(F.col("end") - F.col("e")) <= 2)
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    return features(placed).join(told, "rid").select("kind", "f", held.alias("held"), right.cast("int").alias("right"))


_TRAINED: dict[float, tuple] = {}


def train(spark, precision: float = 0.95, texts: list | None = None) -> tuple[Column, dict[str, float], dict[str, tuple[float, float]]]:
    """A probability for candidate spans, a threshold for each kind, and its precision and recall on held-out texts.

    What the module's own texts teach is the same each time, so a driver learns it once for each precision.
    """
    if texts is not None:
        start, trees, thresholds, measured = _trained(spark, precision, texts)
    else:
        if precision not in _TRAINED:
            _TRAINED[precision] = _trained(spark, precision, examples())
        start, trees, thresholds, measured = _TRAINED[precision]
    return trees_column(start, trees, F.col("f")), thresholds, measured


def _trained(spark, precision: float, texts: list) -> tuple[float, list, dict[str, float], dict[str, tuple[float, float]]]:
    """Start value, trees, thresholds and what they reach.

    The trees see counts of equal feature vectors of the texts that are not held out. The threshold of a kind is the
    lowest at which its held-out candidates above it are ``precision`` pure and which is 0.5 at least; a kind for which
    there is none gets no additions. Everything here is as large as ``texts``, whatever the corpus.
    """
    cells = labelled(spark, texts).groupBy("kind", "held", "f").agg(F.count("*").alias("n"), F.sum("right").alias("right")).collect()

    def table(of):
        return np.array([r["f"] for r in of], int).reshape(len(of), len(FEATURES)), np.array([r["right"] for r in of], float), np.array([r["n"] for r in of], float)

    start, trees = fit_trees(*table([r for r in cells if not r["held"]]))
    thresholds, measured = {}, {}
    for kind in ALL_KINDS:
        x, right, n = table([r for r in cells if r["held"] and r["kind"] == kind])
        p = _probabilities(start, trees, x)
        thresholds[kind] = 1.01
        for t in np.unique(p[p >= 0.5]):
            chosen = p >= t
            if right[chosen].sum() >= precision * n[chosen].sum():
                thresholds[kind] = float(t) - 1e-9
                break
        chosen = p >= thresholds[kind]
        measured[kind] = (float(right[chosen].sum() / max(1.0, n[chosen].sum())), float(right[chosen].sum() / max(1.0, right.sum())))
    return start, trees, thresholds, measured


def _islands(spans: DataFrame) -> DataFrame:
    """``spans`` with island: a number for each stretch of a row's spans that overlap one another, directly or by others."""
    order = Window.partitionBy("rid").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("begin") < reach, F.lit(False)), 0).otherwise(1)
    return spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def chosen(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as (rid, row), and the spans of all personal data: rid, kind, begin, end, first_byte, last_byte, base.

    Base finds are the strict patterns' leftmost, non-overlapping matches that hold. An added span never overlaps a base
    find nor another added one that is likelier (ties: the earlier, longer one). Spans are weighed within the stretch that
    overlaps with them, so a text of many spans costs little more than several of few.
    """
    rows, placed = candidates(docs)
    marked = features(placed)
    probability, thresholds, _ = train(docs.sparkSession)
    line = Window.partitionBy("rid", "kind").orderBy("begin")
    behind = F.max(F.when(F.col("base"), F.col("end"))).over(line.rangeBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("rid", "kind").orderBy(F.desc("begin"))  # running from the end, as a frame to the end would start anew for each row
    ahead = F.min(F.when(F.col("base"), F.col("begin"))).over(back.rangeBetween(Window.unboundedPreceding, 0))
    sure = F.coalesce(behind > F.col("begin"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    marked = materialize(marked.withColumn("sure", sure).drop("match", "before", "after"), "pii_spans")
    threshold = F.element_at(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]), F.col("kind"))
    own = ["rid", "kind", "begin", "end", "first_byte", "last_byte"]
    base = marked.where("base").select(*own, F.lit(True).alias("base"), F.lit(2.0).alias("p"))
    more = marked.where("not base and not sure").select(*own, F.lit(False).alias("base"), probability.alias("p")).where(F.col("p") >= threshold).dropDuplicates(["rid", "kind", "begin", "end"])
    span = F.struct((-F.col("p")).alias("q"), "begin", (-F.col("end")).alias("back"), "kind", "base", "first_byte", "last_byte")
    grouped = _islands(base.union(more)).groupBy("rid", "island").agg(F.sort_array(F.collect_list(span)).alias("all"))
    meets = lambda s: lambda d: (d["begin"] < -s["back"]) & (s["begin"] < -d["back"])
    added = F.filter("all", lambda s: ~s["base"])
    kept = F.aggregate(added, F.filter("all", lambda s: s["base"]), lambda done, s: F.when(F.exists(done, meets(s)), done).otherwise(F.array_append(done, s)))
    spans = grouped.select("rid", F.explode(F.when(F.size(added) == 0, F.col("all")).otherwise(kept)).alias("s"))
    return rows, spans.select("rid", "s.kind", "s.begin", (-F.col("s.back")).alias("end"), "s.first_byte", "s.last_byte", "s.base")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as (rid, row), and rid, spans: the spans of :func:`chosen` as structs (k, begin, end, kind, base)
    sorted by ``k``, the kind's place in ALL_KINDS."""
    rows, spans = chosen(docs)
    order = F.array(*map(F.lit, ALL_KINDS))
    span = F.struct(F.array_position(order, F.col("kind")).alias("k"), "begin", "end", "kind", "base")
    return rows, spans.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; null text stays null.

    Overlapping spans are replaced together, under the name of the first. Other columns and repeated rows stay.
    """
    rows, spans = chosen(docs)
    text = F.col("row")["text"]
    first = F.min(F.struct("begin", "end", "kind"))["kind"]
    merged = _islands(spans).groupBy("rid", "island").agg(F.min("first_byte").alias("b"), F.max("last_byte").alias("e"), first.alias("kind"))
    found = merged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("b", "e", "kind"))).alias("cuts"))
    before = lambda i: F.coalesce(F.get("cuts", i - 1)["e"], F.lit(0))
    cut = lambda raw, b, e: F.substring(raw, b + 1, e - b).cast("string")
    parts = lambda raw: F.transform("cuts", lambda s, i: F.concat(cut(raw, before(i), s["b"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.get("cuts", F.size("cuts") - 1)["e"]
    # The text's bytes are bound once, so that each piece is cut in time of its own length.
    clean = F.aggregate(F.array(F.encode(text, "utf-8")), F.lit(""), lambda _, raw: F.concat(F.array_join(parts(raw), ""), cut(raw, last, F.octet_length(raw))))
    joined = rows.join(found, "rid", "left")
    clean = F.when(F.col("cuts").isNull(), text).otherwise(clean)
    return joined.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """All ``documents``; the counts by kind and the digest are of base finds, ``spans`` and n_spans of all."""
    rows, found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = rows.select("rid", F.col("row.doc_id").alias("doc_id")).join(found, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))
    base = F.filter("spans", lambda s: s["base"])
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return joined.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
