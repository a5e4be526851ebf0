"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  High-recall generators then propose further,
overlapping spans; boosted trees over format and context features score them; a threshold for each kind, calibrated on
held-back rows, selects the ones to redact.  The trees are fitted with ``pyspark.ml`` on labelled look-alikes that
DataFrame expressions make (no document's data), and are applied as CASE expressions, so the scan stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of the kinds at equal starts.
KINDS = ("email", "ip", "card", "phone", "id", "secret")

# Possessive and anchored forms of the base patterns: the same matches, without backtracking over long runs.  \G lets a
# match start where the one before it ended, although its last character could belong to a local part.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: A run of digits with single blanks or hyphens, whole, of 14 to 19 digits: shorter and longer runs fail and are dropped.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of candidates: name, kind, pattern, cheap guard that a text must pass before the pattern runs; a guard holds
#: wherever its pattern does.
GENERATORS = (
    ("email_spelt", "email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+(?:@|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)[a-z0-9-]{1,63}+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[a-z0-9-]{2,63}+)++", r"(?i)(?:@|[\[(]\s?at\s?[\])]\s?|\sat\s)[a-z0-9-]{1,63}+(?:\.|\s?[\[(]\s?dot|\sdot\s)"),
    ("ip_six", "ip", r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{1,4}(?![0-9a-z:])", r"(?i):[0-9a-f]{0,4}:"),
    ("ip_six_short", "ip", r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?(?![0-9a-z:])", r"::"),
    ("card_dotted", "card", r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])", r"[0-9]{4}[._/][0-9]{4}[._/]"),
    ("phone_local", "phone", r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", r"[0-9]\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
    ("id_dashed", "id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("id_account", "id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("secret_long", "secret", r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+", r"[A-Za-z0-9_/+=-]{20}"),
)
#: Lanes of the base rules; the generators' follow.
BASE_RULES = 4
#: Characters before and after a candidate that the context features read.
CONTEXT = 24
#: Rows made for each generator, half of them look-alikes; a fifth is held back to calibrate.
FIT_ROWS = 600
TREES, DEPTH = 8, 3
#: Share of the held-back look-alikes that may pass a kind's threshold.
FALSE_SHARE = 0.005

_FEATURES = {
    "n": lambda m, b, a: F.length(m),
    "digits": lambda m, b, a: F.length(F.regexp_replace(m, "[^0-9]", "")),
    "letters": lambda m, b, a: F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
    "uppers": lambda m, b, a: F.length(F.regexp_replace(m, "[^A-Z]", "")),
    "marks": lambda m, b, a: F.length(F.regexp_replace(m, r"[^\x20().:/@\[\]_-]", "")),
    "switches": lambda m, b, a: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]", "")),
    "at": lambda m, b, a: m.rlike(r"(?i)@|\bat\b").cast("int"),
    "dots": lambda m, b, a: m.rlike(r"(?i)[\[(\s]dot[\])\s]").cast("int"),
    "bracketed": lambda m, b, a: m.rlike(r"(?i)[\[(]\s?at\s?[\])]").cast("int"),
    "cases": lambda m, b, a: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[a-z]+", "a"), "[A-Z]+", "A"), "[^aA]", "")),
    "luhn": lambda m, b, a: luhn(m).cast("int"),
    "hex": lambda m, b, a: m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
    "date": lambda m, b, a: m.rlike(r"(?:19|20)[0-9]{2}[./\x20-](?:0[1-9]|1[0-2])|^[0-9]{1,2}:[0-9]{2}:").cast("int"),
    "quoted": lambda m, b, a: (b.rlike("[\"'=:]\\s?[\"']?$") & a.rlike("^[\"';,\\s]|^$")).cast("int"),
    "says_secret": lambda m, b, a: b.rlike(r"(?i)token|secret|passw|api.?key|credential|bearer").cast("int"),
    "says_phone": lambda m, b, a: b.rlike(r"(?i)\btel|phone|call|mobile|fax|cell|\bt[eé]l").cast("int"),
    "says_pay": lambda m, b, a: b.rlike(r"(?i)card|visa|master|amex|pay|credit").cast("int"),
    "says_id": lambda m, b, a: b.rlike(r"(?i)ssn|social|iban|account|passport|tax").cast("int"),
    "says_mail": lambda m, b, a: b.rlike(r"(?i)mail|contact|write|reach").cast("int"),
    "says_other": lambda m, b, a: b.rlike(r"(?i)order|invoice|version|isbn|part|serial|page|date|total|ref|commit|sha|build|time|\$|#|http|www").cast("int"),
}


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn check (a number without digits does not)."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return (F.size(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once however often ``then`` reads it."""
    return F.transform(F.array(value), then)[0]


#: Elements of a piece of a walked array; code points of a piece of a cut text.
STRIDE = 256
PIECE = 1024
_SPAN = "a:int,b:int,m:string,kind:string,lane:int"


def _pieces(items: Column) -> Column:
    """An array in pieces of STRIDE elements."""
    each = lambda all_: F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / STRIDE).cast("int")), lambda k: F.slice(all_, k * STRIDE + 1, STRIDE))
    return let(items, lambda all_: F.when(F.size(all_) > 0, each(all_)).otherwise(F.array(all_)))


def walk(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]], end: Callable[[Column], Column] | None = None) -> Column:
    """What a walk over ``items`` puts out, an array of type ``out``: ``step(state, item)`` gives the next state and the
    array it puts out, ``end`` what the last state puts out.

    Appending to an array copies it, so the walk appends within pieces, and pieces as wholes to one another: what is
    copied grows with the items, not with their square."""

    def inside(acc: Column, item: Column) -> Column:
        after, more = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

    def over(acc: Column, piece: Column) -> Column:
        zero = F.struct(acc["state"].alias("state"), F.array().cast(out).alias("out"))
        # not by ``let``, which copies what it gives: that would be all of ``out`` for each piece
        return F.aggregate(piece, zero, inside, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out"))
    return F.aggregate(_pieces(items), zero, over, lambda r: F.concat(F.flatten(r["out"]), end(r["state"])) if end else F.flatten(r["out"]))


def places(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, as structs (a, b, m): start and end in code points, matched text.

    What the pattern splits off between the matches gives the starts."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(hits.alias("m"), gaps.alias("gap")), lambda p: p["m"].isNotNull())
    sized = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("g"), F.length(p["m"]).alias("n"), p["m"].alias("m")))
    span = lambda a, p: F.array(F.struct(a.alias("a"), (a + p["n"]).alias("b"), p["m"].alias("m")))
    return walk(sized, F.lit(0), "array<struct<a:int,b:int,m:string>>", lambda at, p: (at + p["g"] + p["n"], span(at + p["g"], p)))


def text_pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, by way of larger ones, so that no piece is sought from the text's start."""
    many = lambda t, n: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), ((F.length(t) - 1) / n).cast("int")), lambda k: F.substring(t, k * n + 1, n))).otherwise(F.array(t))
    return F.flatten(F.transform(many(text, 64 * PIECE), lambda t: many(t, PIECE)))


def cut(pieces: Column, a: Column, b: Column) -> Column:
    """The code points from a to b, or to the end of the text that the pieces make up."""
    first, last = (a / PIECE).cast("int"), ((b - 1) / PIECE).cast("int")
    part = lambda k, at, n: F.coalesce(F.substring(F.get(pieces, k), at + 1, n), F.lit(""))
    apart = F.concat(part(first, a - first * PIECE, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), part(last, F.lit(0), b - last * PIECE))
    return F.when(b <= a, "").when(first == last, part(first, a - first * PIECE, b - a)).otherwise(apart)


def unbeaten(spans: Column, lanes: int, total: bool) -> Column:
    """The ``spans`` (a, b, m, kind, lane, rank) that no overlapping span of lesser rank beats, sorted; with ``total`` equal
    ranks go by start, end and lane.

    Spans of one lane do not overlap, so one walk by start that holds each lane's last span meets all overlapping pairs."""
    held, names = f"struct<{_SPAN},rank:double,beaten:boolean>", ("a", "b", "m", "kind", "lane", "rank")
    order = lambda s: F.struct(s["rank"], s["a"], s["b"], s["lane"])
    beats = lambda s, t: (order(s) < order(t)) if total else (s["rank"] < t["rank"])
    marked = lambda s, beaten: F.struct(*(s[n].alias(n) for n in names), beaten.alias("beaten"))
    free = lambda spans: F.filter(spans, lambda s: s.isNotNull() & ~s["beaten"])

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        meets = lambda t: t.isNotNull() & (t["b"] > s["a"])
        mine = F.exists(state, lambda t: meets(t) & beats(t, s))
        after = F.transform(state, lambda t, k: F.when(k == s["lane"], marked(s, mine)).when(meets(t) & beats(s, t), marked(t, F.lit(True))).otherwise(t))
        return after, free(F.array(F.get(state, s["lane"])))

    start = F.array_repeat(F.lit(None).cast(held), lanes)
    return F.array_sort(walk(F.array_sort(spans), start, f"array<{held}>", step, free))


def _guarded(text: Column, guard: Column, spans: Column, kind: str, lane: int) -> Column:
    """``spans`` with their kind and lane where the guard holds, else none, so most texts skip the pattern."""
    full = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["m"].alias("m"), F.lit(kind).alias("kind"), F.lit(lane).alias("lane")))
    return F.when(guard, full).otherwise(F.array().cast(f"array<struct<{_SPAN}>>"))


def base_spans(text: Column) -> Column:
    """The base rules' spans (a, b, m, kind, lane); a lane is a rule."""
    n_digits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    octets = lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    found = (
        _guarded(text, text.contains("@"), places(text, EMAIL), "email", 0),
        _guarded(text, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(places(text, IP), lambda s: octets(s["m"])), "ip", 1),
        _guarded(text, text.rlike(CARD), F.filter(places(text, CARD), lambda s: luhn(s["m"])), "card", 2),
        _guarded(text, text.rlike(r"\+[0-9]"), F.filter(places(text, PHONE), lambda s: n_digits(s["m"]).between(10, 15)), "phone", 3),
    )
    return F.concat(*found)


def candidates(text: Column) -> Column:
    """All generators' spans (a, b, m, kind, lane); a lane is a generator."""
    return F.concat(*(_guarded(text, text.rlike(guard), places(text, pattern), kind, BASE_RULES + k) for k, (_, kind, pattern, guard) in enumerate(GENERATORS)))


def features(span: Column, before: Column, after: Column, kind: Column) -> dict[str, Column]:
    out = {name: fn(span, before, after).cast("double") for name, fn in _FEATURES.items()}
    return out | {f"is_{k}": (kind == k).cast("double") for k in KINDS}


def training_rows(spark: SparkSession) -> DataFrame:
    """Labelled candidates: (kind, before, m, after, label, held_back), made from hashes of a row number.

    Each generator has forms of real data and forms that only look like it, with telling and neutral contexts."""
    rows = spark.range(FIT_ROWS)
    num = lambda k, salt: F.lpad(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(10**k)).cast("string"), k, "0")
    pick = lambda salt, *of: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(of))) + 1).cast("int"))
    word = lambda salt: pick(salt, "anna", "m.koch", "lee_92", "support", "info.desk", "j-doe", "the.24", "or88")
    host = lambda salt: pick(salt, "example", "mail4", "corp-net", "uni", "homebox")
    md = F.md5(F.concat(F.lit("secret"), F.col("id").cast("string")))
    sha = F.sha1(F.concat(F.lit("s"), F.col("id").cast("string")))
    b64 = F.translate(F.base64(F.unhex(sha)), "=", "")
    plain = ["of the ", "and then ", "Une de la ", "wird mit ", "", "on "]
    forms: list[tuple[str, int, Column, list[str], list[str]]] = [
        ("email", 1, F.concat(word("w"), pick("a1", " (at) ", "[at]", " at ", "(at)"), host("h"), pick("d1", " dot ", "(dot)", "[dot]", " (dot) "), pick("t", "com", "org", "net", "de")), [*plain, "mail: ", "contact ", "write to "], [" now", "", ". The"]),
        ("email", 1, F.concat(word("w"), pick("a2", " (at) ", "[at]", " [at] ", "(at)"), host("h"), F.lit("."), pick("t", "com", "org", "net", "de")), [*plain, "mail: ", "contact ", "write to "], [" now", "", ". The"]),
        ("email", 0, F.concat(pick("w0", "look", "we met", "stop", "ends"), F.lit(" at "), pick("h0", "home", "noon", "the", "a"), pick("d0", ".Then", ".and", ".We")), plain, [" and", " dot "]),
        ("ip", 1, F.concat_ws(":", *(F.substring(md, 1 + 4 * k, 4) for k in range(8))), [*plain, "host ", "from ", "address "], [" to", "", ","]),
        ("ip", 1, pick("s6", F.concat(F.lit("fe80::"), num(1, "s1")), F.concat(F.lit("2001:db8:"), num(2, "s2"), F.lit("::")), F.lit("2001:db8::"), F.concat(F.lit("2001:db8::"), F.substring(md, 1, 4), F.lit(":"), num(2, "s3")), F.concat(F.lit("fd"), num(2, "s4"), F.lit("::"), F.substring(md, 5, 4))), [*plain, "host ", "from ", "address "], [" to", "", ","]),
        ("ip", 0, pick("n6", "::", "a::b", "::add", "dead::", "c::f", "bad::face"), [*plain, "call ", "use "], [" to", "", "("]),
        ("ip", 0, F.concat_ws(":", num(2, "h"), num(2, "m"), num(2, "s"), num(2, "f")), [*plain, "time ", "date "], [" to", ""]),
        ("card", 1, _valid_card(F.concat(F.lit("4"), num(14, "c")), pick("cs", ".", "_", "/")), [*plain, "card ", "visa ", "pay with "], ["", " and", "."]),
        ("card", 0, _joined(pick("cs", ".", "_", "/"), num(4, "1"), num(4, "2"), num(4, "3"), num(4, "4")), [*plain, "part ", "serial ", "ref "], ["", " and"]),
        ("phone", 1, pick("pf", F.concat(F.lit("("), num(3, "p1"), F.lit(") "), num(3, "p2"), F.lit("-"), num(4, "p3")), F.concat_ws("-", num(3, "p1"), num(3, "p2"), num(4, "p3")), F.concat_ws(".", num(3, "p1"), num(3, "p2"), num(4, "p3")), F.concat(F.lit("0049 "), num(3, "p1"), F.lit(" "), num(4, "p2"), F.lit(" "), num(4, "p3"))), [*plain, "call ", "tel ", "phone: ", "mobile "], ["", " now", ". The"]),
        ("phone", 0, pick("pf", F.concat_ws(" ", num(3, "p1"), num(3, "p2"), num(3, "p3")), F.concat_ws(".", num(2, "p1"), num(3, "p2"), num(3, "p3")), F.concat_ws("-", F.lit("2024"), num(3, "p2"), num(4, "p3")), F.concat_ws(" ", num(4, "p1"), num(4, "p2"), num(4, "p3"))), [*plain, "order ", "total $", "invoice #", "part ", "version "], ["", " units", "."]),
        ("id", 1, pick("if", F.concat_ws("-", num(3, "i1"), num(2, "i2"), num(4, "i3")), F.concat(pick("cc", "DE", "FR", "ES", "GB"), num(2, "k"), num(18, "b"))), [*plain, "ssn ", "iban ", "account ", "social security "], ["", " and", "."]),
        ("id", 0, pick("if", F.concat_ws("-", num(3, "i1"), num(2, "i2"), num(4, "i3")), F.concat(pick("cc", "AB", "XY", "QZ", "TK"), num(2, "k"), num(12, "b"))), ["order ", "part ", "serial ", "ref ", "invoice #", "isbn "], ["", " and"]),
        ("secret", 1, pick("sf", sha, md, b64, F.upper(sha), F.concat(F.lit("sk_"), F.substring(b64, 1, 24))), [*plain, 'token = "', "api_key: ", 'secret="', "Bearer ", "password = '"], ['" the', "'", "", ' ";', " and"]),
        ("secret", 1, pick("sl", F.translate(b64, "0123456789", "QxZvKjWqYp"), F.translate(F.concat(b64, F.substring(b64, 3, 16)), "0123456789", "KqYpQxZvJw"), F.concat(F.translate(F.concat(b64, b64), "0123456789", "QxZvKjWqYp"), num(2, "sd"))), [*plain, 'token = "', "api_key: ", 'secret="', "Bearer ", "password = '"], ['" the', "'", "", ' ";', " and"]),
        ("secret", 0, pick("sn", "Oneaverylongwordthatruns", "the_long_name_of_a_field", "path/to/some/file/here/too", "--------------------------", "==========================", "AbstractFactoryBeanOfBeans", "averyveryverylongcompoundword", "state-of-the-art-machines", "THE_LONG_NAME_OF_A_CONSTANT", "Path/To/Some/File/Here/Too"), [*plain, "http://www.example.com/", "version ", "ref "], ["", " and", "."]),
        ("secret", 0, pick("sf", F.concat(F.lit("the_long_name_of_a_field_"), num(1, "x")), F.concat(F.lit("path/to/some/file/here-"), num(2, "x")), F.concat(F.lit("-" * 18), num(2, "y")), F.concat(F.lit("averyverylongcompoundword"), num(1, "x")), F.concat(num(10, "y"), num(10, "z"))), [*plain, "http://www.example.com/", "version ", "ref "], ["", " and", "."]),
    ]
    parts = []
    for k, (kind, label, m, before, after) in enumerate(forms):
        salt = f"form{k}"
        parts.append(rows.withColumn("id", F.col("id") + F.lit(k * FIT_ROWS)).select(F.lit(kind).alias("kind"), pick(salt + "b", *before).alias("before"), m.alias("m"), pick(salt + "a", *after).alias("after"), F.lit(label).alias("label"), (F.col("id") % 5 == 0).alias("held_back")))
    return reduce(DataFrame.unionByName, parts)


def _valid_card(body: Column, mark: Column) -> Column:
    """Fifteen digits with their check digit, in fours."""
    checks = [F.concat(body, F.lit(str(d))) for d in range(10)]
    whole = F.coalesce(*(F.when(luhn(c), c) for c in checks))
    return _joined(mark, *(F.substring(whole, 1 + 4 * k, 4) for k in range(4)))


def _joined(mark: Column, *parts: Column) -> Column:
    return F.concat(parts[0], *(x for p in parts[1:] for x in (mark, p)))


class Booster:
    """Fitted trees as expressions over a feature struct, with a threshold for each kind."""

    def __init__(self, names: list[str], trees: list[tuple[float, object]], thresholds: dict[str, float]):
        self.names, self.trees, self.thresholds = names, trees, thresholds

    def score(self, of: dict[str, Column]) -> Column:
        """Probability of personal data."""
        total = F.lit(0.0)
        for weight, node in self.trees:
            total = total + F.lit(weight) * self._node(node, of)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total))

    def _node(self, node, of: dict[str, Column]) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, limit, left, right = node
        return F.when(of[self.names[feature]] <= F.lit(limit), self._node(left, of)).otherwise(self._node(right, of))


def _tree(node) -> object:
    """A fitted tree as nested (feature, threshold, left, right) with leaf values."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(spark: SparkSession) -> Booster:
    """Fits the trees and calibrates a threshold for each kind on the held-back rows."""
    rows = training_rows(spark)
    of = features(F.col("m"), F.col("before"), F.col("after"), F.col("kind"))
    table = rows.select("kind", "held_back", F.col("label").cast("double").alias("label"), *(c.alias(n) for n, c in of.items())).coalesce(2).cache()
    names = list(of)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(table.where(~F.col("held_back")))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=7, maxBins=32).fit(vectors)
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]
    booster = Booster(names, trees, {})
    scored = table.where("held_back").select("kind", "label", booster.score({n: F.col(n) for n in names}).alias("p"))
    limits = scored.groupBy("kind").agg(F.percentile(F.when(F.col("label") == 0, F.col("p")), 1 - FALSE_SHARE).alias("t")).collect()  # a row for each kind
    table.unpersist()
    booster.thresholds = {r["kind"]: min(0.97, max(0.5, (r["t"] or 0.0) + 0.02)) for r in limits}
    return booster


def find(docs: DataFrame, booster: Booster) -> DataFrame:
    """``docs``' doc_id with the text and the arrays ``base`` and ``added`` of structs (a, b, m, kind, lane); added have a
    rank (minus the probability) and beaten (false), too.

    An added span overlaps no base span and no likelier added one (of equally likely ones the earlier, then the shorter
    stays), whether or not that one stays itself.  Null texts are empty; texts of any length and with any number of spans
    are scanned whole, in time that grows with both; repeated rows are scanned alike.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("cand"))
    names = ("a", "b", "m", "kind", "lane")
    ranked = lambda array, rank: F.transform(array, lambda s: F.struct(*(s[n].alias(n) for n in names), rank(s).alias("rank")))
    limit = lambda kind: reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), booster.thresholds.items(), F.lit(1.0))
    lanes = BASE_RULES + len(GENERATORS)
    both = F.concat(ranked(F.col("base"), lambda s: F.lit(0.0)), ranked(F.col("cand"), lambda s: F.lit(1.0)))
    apart = F.filter(unbeaten(both, lanes, total=False), lambda s: s["lane"] >= BASE_RULES)

    def scored(fresh: Column) -> Column:
        def rank(pieces: Column, s: Column) -> Column:
            before, after = cut(pieces, F.greatest(s["a"] - CONTEXT, F.lit(0)), s["a"]), cut(pieces, s["b"], s["b"] + CONTEXT)
            around = F.struct(before.alias("before"), after.alias("after"))
            return -let(around, lambda c: booster.score(features(s["m"], c["before"], c["after"], s["kind"])))

        judged = let(text_pieces(F.col("text")), lambda pieces: ranked(fresh, lambda s: rank(pieces, s)))
        return F.when(F.size(fresh) > 0, unbeaten(F.filter(judged, lambda s: -s["rank"] >= limit(s["kind"])), lanes, total=True)).otherwise(none)

    none = F.array().cast(f"array<struct<{_SPAN},rank:double,beaten:boolean>>")
    return spans.select("doc_id", "text", "base", F.when(F.size("cand") > 0, let(apart, scored)).otherwise(none).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["b"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base rules' counts and digest, and all spans."""
    found = find(docs, fit(docs.sparkSession))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat(slim(F.col("base")), slim(F.col("added")))).alias("spans"),
    )


def redact(docs: DataFrame, booster: Booster | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; base spans that overlap are merged."""
    booster = booster or fit(docs.sparkSession)
    found = find(docs, booster)
    slim = lambda c: F.transform(c, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(slim(F.col("base")), slim(F.col("added"))))

    def clean(pieces: Column) -> Column:
        label = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        step = lambda at, s: (F.greatest(at, s["b"]), F.when(s["a"] >= at, F.array(cut(pieces, at, s["a"]), label(s))).otherwise(F.array().cast("array<string>")))
        return F.array_join(walk(spans, F.lit(0), "array<string>", step, lambda at: F.array(cut(pieces, at, F.size(pieces) * PIECE))), "")

    return found.select("doc_id", let(text_pieces(F.col("text")), clean).alias("text"))
