"""Personal data: base patterns, and identifiers found by bootstrapped context patterns.

Base spans (email, ip, card, phone) come from regular expressions with checks. They, and
values whose form alone marks an identifier (FORMS), are the seeds of the bootstrap. An
instance is a seed, a token with a digit, or a value behind an equals sign; its lexical
patterns are the words next to it with the sign that ties them to it (`token=`), the
word before with the word after, and the word before with the shape of the value. In
each round Spark scores patterns by the known share of the distinct instances that they
extract: the lower bound of that share must pass LEAST_SHARE and the known share of all
other instances. Instances of high-confidence patterns become known. Tokens of such
instances become spans of kind `id`; a seed by form becomes one only in this way.

Native expressions only: texts stay in one narrow pass of linear time (running sums and
maxima by blocks), and only the rows of instances are shuffled.

Offsets count code points, the end is exclusive. Defined cases: a null or empty text has
no spans. Rows are handled one by one, so repeated rows give repeated results. Other
columns are not read. An empty table gives no rows. A frequent pattern or instance is
summed before it is shuffled, and joins to them are salted. No context is an instance's
pattern where no word stands before it. Keys of more than KEY_CHARS are their digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. A match begins where no run of its first class precedes it,
#: or where the match before ended (\\G): the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A token with a digit, or behind an equals sign: no white space, quotes or equals sign.
_IN = r"[^\x09-\x0D\x20\"'<>=]"
TOKENS = rf"(?:\G|(?<!{_IN})){_IN}*[0-9]{_IN}*|(?<==[\x20\"']{{0,2}}){_IN}{{4,}}"
#: A key and a colon, and signs, before the value of a token.
PREFIX = r"^(?:[A-Za-z_-]+:)?[^\p{L}\p{N}]*"
#: Values that are identifiers by form: long hexadecimal digests, UUIDs, signed web
#: tokens, and keys with the published prefixes of cloud and code hosts.
FORMS = (
    r"^(?:(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*|AKIA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,})$"
)
ROUNDS, LEAST_SHARE, MIN_CONFIDENCE, Z = 3, 0.7, 0.9, 1.645
KEY_CHARS, BLOCK, PIECE, SALTS = 200, 128, 4096, 32


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.concat(F.lit("0"), F.substring(p, 1, 3)).cast("int") <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


_SPANS = "array<struct<start:int,end:int,kind:string,match:string>>"
_FOUND = "array<struct<start:int,end:int,kind:string,match:string,left:string,right:string>>"
_Op = Callable[[Column, Column], Column]


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(before: Column, x: Column) -> Column:
    return F.coalesce(before, F.lit(0)) + x


def _running(values: Column, op: _Op) -> Column:
    """The running results of op over an array of ints; op takes null as the start. Blocks
    are folded by themselves and then shifted, since a fold that appends copies its array."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(op(F.try_element_at(a, F.lit(-1)), x))))

    def blocks(all_: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK))
        return _let(F.transform(begins, lambda i: fold(F.slice(all_, i + 1, F.lit(BLOCK)))), shifted)

    def shifted(parts: Column) -> Column:
        heads = F.concat(F.array(F.lit(None).cast("int")), fold(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1)))))
        return F.flatten(F.zip_with(parts, F.slice(heads, F.lit(1), F.size(parts)), lambda p, h: F.transform(p, lambda x: op(h, x))))

    return _let(values, blocks)


def _before(running: Column, first: int) -> Column:
    """Each running result as it was before its own element."""
    return F.slice(F.concat(F.array(F.lit(first)), running), F.lit(1), F.size(running))


def _words(part: Column) -> Column:
    """part with single spaces for white space, quotes and brackets, an equals sign or
    colon at its end tied to the word before."""
    flat = F.regexp_replace(part, r"[\s\"'<>]+", " ")
    return F.trim(F.regexp_replace(flat, " ?([=:]) ?$", "$1"))


def located(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, kind, match, left, right>> of a pattern's matches: the gaps
    between them come from a split, the offsets from running sums of lengths, and the
    words at both sides (two before, one after) from gaps and neighbours."""
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def place(w: Column) -> Column:
        m, g, n = w["m"], w["g"], F.size(w["m"])
        empty = F.array(F.lit(""))
        after = F.zip_with(F.slice(g, F.lit(2), n), F.concat(F.slice(m, F.lit(2), n), empty), lambda a, b: F.concat(a, b))
        before = F.zip_with(F.slice(F.concat(empty, m), F.lit(1), n), F.slice(g, F.lit(1), n), lambda a, b: F.concat(a, b))
        ends = _running(F.zip_with(F.slice(g, F.lit(1), n), m, lambda a, b: F.length(a) + F.length(b)), _sum)
        return F.transform(
            F.arrays_zip(m.alias("m"), ends.alias("e"), before.alias("b"), after.alias("a")),
            lambda p: F.struct(
                (p["e"] - F.length(p["m"])).alias("start"), p["e"].alias("end"), F.lit(kind).alias("kind"), p["m"].alias("match"),
                F.lower(F.substring_index(_words(p["b"]), " ", -2)).alias("left"),
                F.lower(F.substring_index(_words(p["a"]), " ", 1)).alias("right"),
            ),
        )

    return _let(whole, lambda w: F.when(F.size(w["m"]) > 0, place(w)).otherwise(_none(_FOUND)))


def _base_found(text: Column) -> Column:
    """All base matches that pass their checks, kind by kind, with the words beside them."""

    def of(kind: str) -> Column:
        need = NEEDS[kind]
        wanted = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
        found = F.when(wanted, located(text, PATTERNS[kind], kind)).otherwise(_none(_FOUND))
        return F.filter(found, lambda s: _passes(kind, s["match"]))

    return F.concat(*map(of, KINDS))


def base_spans(text: Column) -> Column:
    """All base spans that pass their checks, kind by kind; text is not null."""
    return _plain(_base_found(text))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"]))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, (*KINDS, "id"))), kind)
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank(s["kind"]).alias("rank"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _tokens(text: Column) -> Column:
    """Tokens cut to their values: a key with a colon goes to the words before."""

    def value(t: Column) -> Column:
        prefix = F.regexp_extract(t["match"], PREFIX, 0)
        cut = F.regexp_replace(F.substring(t["match"], F.length(prefix) + 1, F.length(t["match"])), r"[^\p{L}\p{N}]+$", "")
        key = F.lower(F.regexp_extract(prefix, "^[A-Za-z_-]+:", 0))
        start = t["start"] + F.length(prefix)
        left = F.when(key != "", F.substring_index(F.concat_ws(" ", t["left"], key), " ", -2)).otherwise(t["left"])
        return F.struct(
            start.alias("start"), (start + F.length(cut)).alias("end"), t["kind"], cut.alias("match"), left.alias("left"), t["right"]
        )

    found = F.when(text.rlike("[0-9=]"), located(text, TOKENS, "id")).otherwise(_none(_FOUND))
    return F.filter(F.transform(found, value), lambda t: t["match"] != "")


def _apart(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span, by running maxima over both in order."""
    sides = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.lit(-1).alias("i"))),
        F.transform(tokens, lambda s, i: F.struct(s["start"].alias("s"), s["end"].alias("e"), i.alias("i"))),
    )

    def free(order: Column) -> Column:
        reached = _running(F.transform(order, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(-1)), F.greatest)
        begins = F.transform(F.reverse(order), lambda x: F.when(x["i"] < 0, x["s"]).otherwise(2**31 - 1))
        rows = F.arrays_zip(order.alias("o"), reached.alias("r"), F.reverse(_running(begins, F.least)).alias("b"))
        kept = F.filter(rows, lambda x: (x["o"]["i"] >= 0) & (x["r"] <= x["o"]["s"]) & (x["b"] >= x["o"]["e"]))
        return F.transform(kept, lambda x: F.get(tokens, x["o"]["i"]))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(F.array_sort(sides), free))


def _shape(value: Column) -> Column:
    """Runs of letters and digits as one sign each, mixed ones as x, and the size class."""
    runs = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "9")
    return F.concat(F.regexp_replace(runs, "[a9]{3,}", "x"), F.lit("~"), F.floor(F.log2(F.length(value))).cast("string"))


def _key(name: Column) -> Column:
    return F.when(F.length(name) > KEY_CHARS, F.sha2(name, 256)).otherwise(name)


def _contexts(left: Column, right: Column, value: Column) -> Column:
    """The patterns of an instance; none where no word stands before it."""
    one = F.substring_index(left, " ", -1)
    two = F.when(F.contains(left, F.lit(" ")), F.array(F.concat(F.lit("LL "), left))).otherwise(F.array().cast("array<string>"))
    rest = F.array(
        F.concat(F.lit("L "), one), F.concat(F.lit("LR "), one, F.lit(" _ "), right), F.concat(F.lit("LS "), one, F.lit(" "), _shape(value))
    )
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.transform(F.concat(two, rest), _key))


def _extracted(base: Column, tokens: Column) -> Column:
    """array<struct<span, base, seed, patterns>> of base spans and other tokens."""

    def told(is_base: bool) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            F.struct(s["start"], s["end"], s["kind"], s["match"]).alias("span"), F.lit(is_base).alias("base"),
            (F.lit(True) if is_base else s["match"].rlike(FORMS)).alias("seed"),
            _contexts(s["left"], s["right"], s["match"]).alias("patterns"),
        )

    return F.concat(F.transform(base, told(True)), F.transform(tokens, told(False)))


def scan(docs: DataFrame) -> DataFrame:
    """docs plus base and extracted, in one narrow pass."""
    text = F.coalesce(F.col("text"), F.lit(""))
    both = F.struct(_base_found(text).alias("base"), _tokens(text).alias("tokens"))
    told = _let(both, lambda b: F.struct(b["base"], _apart(b["base"], b["tokens"]).alias("tokens")))
    found = _let(told, lambda b: F.struct(_plain(b["base"]).alias("base"), _extracted(b["base"], b["tokens"]).alias("extracted")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*names, found.alias("found")).select(*names, "found.base", "found.extracted")


def _least(hits: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of hits out of n."""
    p = hits / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _salted(df: DataFrame) -> DataFrame:
    """df once for each salt, to be merged and not broadcast."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def bootstrap(extracted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Instances (column match, as _key gives it) that high-confidence patterns extract.

    A pattern is kept if the lower bound of the known share of its distinct instances is
    LEAST_SHARE or more and above the known share of all others. An instance is known
    from then on if patterns of half or more of the words before it are kept and the
    chance that these all err is at most 1 - MIN_CONFIDENCE.
    """
    graph = stage(
        extracted.select(F.explode("extracted").alias("x"))
        .select(_key(F.col("x.span.match")).alias("match"), "x.seed", F.explode("x.patterns").alias("pattern"))
        .groupBy("match", "pattern")
        .agg(F.max("seed").alias("known"))
    )
    while True:
        n, k = graph.groupBy("match").agg(F.max("known").alias("k")).agg(F.count("*"), F.count_if("k")).first()
        scored = graph.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("known").alias("hits"))
        others = F.when(F.col("n") < n, (k - F.col("hits")) / (n - F.col("n"))).otherwise(0.0)
        least = _least(F.col("hits"), F.col("n"))
        kept = scored.where((least >= LEAST_SHARE) & (least > others))
        kept = _salted(kept.select("pattern", F.log((F.col("n") - F.col("hits") + 0.5) / (F.col("n") + 1)).alias("doubt")))
        marked = graph.withColumn("salt", _salt("match")).join(kept, ["pattern", "salt"], "left")
        words = F.count_if(F.col("pattern").startswith("L "))
        supported = F.greatest(*[F.count_if(F.col("doubt").isNotNull() & F.col("pattern").startswith(f"{p} ")) for p in ("L", "LL", "LR", "LS")])
        known = marked.groupBy("match").agg(F.sum("doubt").alias("doubt"), (2 * supported >= words).alias("most"))
        found = stage(known.where((F.exp("doubt") <= 1 - MIN_CONFIDENCE) & F.col("most")).select("match"))
        rounds -= 1
        if rounds <= 0:
            return found
        news = _salted(found.withColumn("new", F.lit(True)))
        joined = graph.withColumn("salt", _salt("pattern")).join(news, ["match", "salt"], "left")
        more = stage(joined.select("match", "pattern", (F.col("known") | F.coalesce("new", F.lit(False))).alias("known")))
        if more.where("known").count() == graph.where("known").count():
            return found
        graph = more


def _discovered(scanned: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """(by, found): the spans of new instances of each row."""
    spans = scanned.select(by, F.explode("extracted").alias("x")).where("NOT x.base").select(by, "x.span")
    spans = spans.withColumn("match", _key(F.col("span.match"))).withColumn("salt", _salt(by))
    return spans.join(_salted(new), ["match", "salt"], "left_semi").groupBy(by).agg(F.collect_set("span").alias("found"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, end, kind, match>, the base spans
    and all spans. Rows are told apart by a row id, so repeated ids stay apart."""
    scanned = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scanned = stage(scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "extracted"))
    found = _discovered(scanned, bootstrap(scanned), "row")
    return scanned.select("row", "doc_id", "base").join(found, "row", "left").select(
        "doc_id", "base", F.concat("base", F.coalesce("found", _none())).alias("spans")
    )


def _replaced(text: Column, spans: Column) -> Column:
    """text with the kinds of its spans in brackets. Texts are cut into PIECEs once, so that
    no part is counted from the beginning of a long text."""

    def build(w: Column) -> Column:
        pieces, order = w["pieces"], w["order"]

        def part(lo: Column, hi: Column) -> Column:
            a, b = F.floor(lo / PIECE).cast("int"), F.floor(hi / PIECE).cast("int")
            inside = lambda i, x, y: F.substring(F.coalesce(F.get(pieces, i), F.lit("")), x - i * PIECE + 1, y - x)
            between = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
            return F.when(a == b, inside(a, lo, hi)).otherwise(F.concat(inside(a, lo, (a + 1) * PIECE), between, inside(b, b * PIECE, hi)))

        reached = _running(F.transform(order, lambda s: s["end"]), F.greatest)

        def parts(r: Column) -> Column:
            rows = F.arrays_zip(order.alias("s"), _before(r, 0).alias("at"))
            rows = F.filter(rows, lambda x: x["s"]["start"] >= x["at"])
            done = F.transform(rows, lambda x: F.concat(part(x["at"], x["s"]["start"]), F.lit("["), x["s"]["kind"], F.lit("]")))
            return F.concat(F.array_join(done, ""), part(F.element_at(r, -1), w["n"]))

        return _let(reached, parts)

    keyed = F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("minus"), s["end"], s["kind"]))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = F.struct(pieces.alias("pieces"), F.array_sort(keyed).alias("order"), F.length(text).alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(_let(whole, build))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets; of overlapping
    spans the first, and of those that start together the longest, names the whole run.

    Texts without a token outside the base spans stay in a narrow pass; if something was
    discovered, the others meet its spans by the digest of the text (which decides its
    spans), salted, so that no plan of docs and no number of copies harms the result.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    rows = scan(docs.select(whole, "text"))
    scanned = stage(rows.where(F.size("extracted") > 0).select(F.md5("text").alias("digest"), "extracted"))
    new = bootstrap(scanned)
    if new.isEmpty():
        spanned = rows.select("doc", "text", F.col("base").alias("spans"))
    else:
        some = F.exists("extracted", lambda x: ~x["base"])
        found = _salted(_discovered(scanned, new, "digest"))
        meet = rows.where(some).select("doc", "text", "base", F.md5("text").alias("digest"))
        meet = meet.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        meet = meet.join(found, ["digest", "salt"], "left").select("doc", "text", F.concat("base", F.coalesce("found", _none())).alias("spans"))
        spanned = meet.union(rows.where(~some).select("doc", "text", F.col("base").alias("spans")))
    clean = _replaced(F.col("text"), F.col("spans"))
    return spanned.select("doc", clean.alias("text")).select(
        *[F.col("text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names]
    )
