"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they do not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import Scratch, ascii_lower, cut, spread_join, unused

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that Java's matcher needs no recursion and no second look at a run. They
#: find what these find, leftmost and non-overlapping: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), card [0-9]([\x20-]?[0-9])+ of 16 to 19 digits,
#: phone \+[0-9][\x20().0-9-]+[0-9].
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}
#: Identifier-like tokens, from which the bootstrapped patterns may take instances.
TOKEN = r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z@._%+/-]*[0-9])[A-Za-z0-9@._%+/-]++"
#: Identifiers written in short groups of digits and capitals: blanks, brackets and separators between them.
_GROUP = r"[A-Z0-9]{1,5}+(?![A-Za-z0-9@_%+])"
GROUPED = rf"(?<![A-Za-z0-9@._%+/-])[(\[]?{_GROUP}(?:(?:[)\]]?[\x20/.-]|[)\]])[(\[]?{_GROUP}){{1,11}}"
#: What a text must hold for either to have four digits.
FOUR_DIGITS = r"[0-9](?:[A-Za-z@._%+/()\[\]\x20-]*+[0-9]){3}"
#: Code points before an identifier in which its context is looked for.
CONTEXT = 64
#: Kinds of identifiers beyond the base patterns, and what marks a token as one for sure: keys of 128 bits or more in
#: hexadecimal. Such tokens only seed the search: they are found where a context that they teach confirms them.
SEEDS = {"secret": r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"}
#: Spans that one step of a running sum handles.
STEP = 64
#: The order of kinds.
ORDER = (*KINDS, *SEEDS)
SPAN = "array<struct<kind:string,start:int,end:int>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct(start, end, found)> of the matches of ``pattern``, in code points.

    Positions are running sums over matches and the gaps between them, made in steps so that a text with very
    many matches does not copy what it has found so far for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,found:string>>"
    none = F.array().cast(kind)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def part(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STEP).cast("int")), lambda k: F.slice(pairs, k * STEP + 1, F.lit(STEP)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(parts, zero, part, lambda s: F.flatten(s["out"]))).otherwise(none)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def fits(kind: str, found: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(found, r"\."), small)
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct(kind, start, end)> of the base patterns: by kind as listed, then by start."""
    return F.concat(*(_spans_of(text, kind) for kind in KINDS))


def _spans_of(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    need = F.rlike(text, F.lit(NEEDS[kind])) if kind in ("ip", "card") else F.instr(text, NEEDS[kind]) > 0
    spans = F.filter(F.when(need, located(text, PATTERNS[kind])).otherwise(none), lambda s: fits(kind, s["found"]))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _shape(found: Column) -> Column:
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(found, "[^A-Za-z]", ""))
    return (
        F.when(F.instr(found, "@") > 0, F.lit("@"))
        .when(letters == 0, F.concat(F.lit("n"), digits.cast("string")))
        .otherwise(F.concat(F.lit("x"), F.length(found).cast("string")))
    )


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """What stands beside an identifier, in three forms: the two words before it, one word, and one word with the mark after it.

    Words keep the punctuation that follows them; letters are lower-cased and digits made alike. They are looked for
    in ``CONTEXT`` code points, where a word that is cut does not count.
    """
    before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    before = F.when(start > CONTEXT, F.regexp_replace(before, r"^[\p{L}\p{N}_]+", "")).otherwise(before)
    before = F.regexp_replace(F.lower(before), "[0-9]+", "0")
    word = r"[\p{L}\p{N}_]++[^\p{L}\p{N}_]*+"
    two, one = (F.trim(F.regexp_extract(before, f"{w}$", 0)) for w in (word + word, word))
    after = F.regexp_extract(F.substring(text, end + 1, F.lit(2)), r"^[^\p{L}\p{N}\s]+", 0)
    return F.array(two, one, F.when((one != "") & (after != ""), F.concat(one, F.lit(" _ "), after)).otherwise(""))


def _items(text: Column, base: Column) -> Column:
    """Base spans and identifier-like tokens outside them, with contexts, shape and the text itself."""
    tokens = F.when(F.rlike(text, F.lit(FOUR_DIGITS)), F.array_distinct(F.concat(located(text, TOKEN), located(text, GROUPED)))).otherwise(
        F.array().cast("array<struct<start:int,end:int,found:string>>")
    )
    loose = F.filter(
        tokens,
        lambda t: (F.length(F.regexp_replace(t["found"], "[^0-9]", "")) >= 4)
        & (F.length(t["found"]) >= 6)
        & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])),
    )

    def item(kind: Column, s: Column, found: Column, new: bool) -> Column:
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(new).alias("new"),
            _contexts(text, s["start"], s["end"]).alias("contexts"), _shape(found).alias("shape"), ascii_lower(found).alias("found"),
        )

    def sure(found: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in SEEDS.items():
            kind = F.when(F.rlike(found, F.lit(pattern)), name).otherwise(kind)
        return kind

    return F.concat(
        F.transform(base, lambda s: item(s["kind"], s, F.substring(text, s["start"] + 1, s["end"] - s["start"]), False)),
        F.transform(loose, lambda s: item(sure(s["found"]), s, s["found"], True)),
    )


def learned_patterns(items: DataFrame, rounds: int, least_seeds: int, least_score: float, scratch: Scratch) -> DataFrame:
    """(pattern, as_kind): contexts that mark personal data, by scores spread over the pattern-instance graph.

    ``items`` has pattern, found and kind (null where nothing knows it). A known instance scores 1. In turn a pattern
    scores the mean of its instances, one made-up instance of score 0 added, and any other instance the mean over its
    contexts of the better pattern. A pattern is a context with an exact shape, or a context alone, which takes shapes
    that no seed has; its kind is that of most of its seeds, of equally many the first as listed. Groups by pattern and
    by instance are pre-aggregated, and joins on a common pattern or instance are dealt out by salt.
    """
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    edges = scratch.table(items.groupBy("pattern", "found").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("k")).select("pattern", "found", F.col("k.kind").alias("kind")))
    n = edges.count()
    kinds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = scratch.table(
        kinds.groupBy("pattern").agg(F.sum("n").alias("seeds"), F.max_by("kind", F.struct("n", -rank)).alias("as_kind"))
    )
    by_found = scratch.table(edges.groupBy("found").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind").isNotNull().cast("double")).alias("s")))
    by_pattern = scratch.table(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    scores, patterns = by_found.select("found", "s"), None
    for turn in range(rounds):
        patterns = spread_join(edges.select("pattern", "found"), scores, ["found"], by_found.select("found", "n"), n)
        patterns = scratch.table(patterns.groupBy("pattern").agg((F.sum("s") / (F.count(F.lit(1)) + 1)).alias("p")))
        if turn < rounds - 1:
            scores = spread_join(edges, patterns, ["pattern"], by_pattern, n)
            scores = scores.groupBy("found", F.substring_index("pattern", "\u0001", 1).alias("context")).agg(
                F.max(F.col("kind").isNotNull().cast("double")).alias("seed"), F.max("p").alias("p")
            )
            scores = scratch.table(scores.groupBy("found").agg(F.greatest(F.max("seed"), F.avg("p")).alias("s")))
    good = patterns.where(F.col("p") >= least_score).join(kinds.where(F.col("seeds") >= least_seeds), "pattern")
    return good.select("pattern", "as_kind")


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    least_seeds: int = 3,
    least_score: float = 0.7,
) -> DataFrame:
    """(doc_id, base, spans, h): personal data of every text, as arrays of (kind, start, end) in code points.

    ``base`` holds the matches of the base patterns that pass their checks. They, and tokens that ``SEEDS`` know for
    sure, seed a graph of lexical patterns and instances over the whole corpus. A pattern is the one or two words before
    an identifier, or the word before and the mark after it, with and without its shape; instances hold
    four digits at least, in one token or in short groups of digits and capitals. Patterns that keep a high score
    over ``rounds`` rounds and rest on ``least_seeds`` different seeds mark further identifiers, which ``spans`` adds under
    the kind of most of the pattern's seeds. ``spans`` is sorted by kind as listed (those of ``SEEDS`` last), then start;
    ``h`` is a hash of the text. A null text counts as empty, without spans. Repeated rows each get their spans; rows
    without id are rows like others; an empty table gives no rows, and other columns play no part. Native expressions
    only; the text is read once.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
        rows = rows.withColumn("base", base_spans(F.col("text")))
        rows = scratch.table(
            rows.select("id", F.xxhash64("text").alias("h"), "base", _items(F.col("text"), F.col("base")).alias("items"))
        )
        items = rows.select("id", "h", F.explode("items").alias("i")).select("id", "h", "i.*")
        shaped = F.transform(
            F.filter("contexts", lambda c: c != ""), lambda c: F.array(F.concat_ws("\u0001", c, "shape"), F.concat_ws("\u0001", c, F.lit("*")))
        )
        items = items.withColumn("pattern", F.explode(F.array_distinct(F.flatten(shaped))))
        patterns = scratch.table(learned_patterns(items, rounds, least_seeds, least_score, scratch))
        if patterns.count() <= 100_000:  # a context, a shape and a kind each: some 10 MB at most
            patterns = F.broadcast(patterns)
        more = (
            items.where("new")
            .join(patterns, "pattern")
            .groupBy("id", "h", "start", "end")
            .agg(F.min_by("as_kind", F.struct(F.endswith("pattern", F.lit("\u0001*")), "as_kind")).alias("as_kind"))
            .groupBy("id", "h")
            .agg(F.collect_set(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("more"))
        )
        key = [F.coalesce("id", F.lit(-(2**63))).alias("k"), "h"]
        wider = lambda s: F.exists("more", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]))
        joined = rows.select(*key, "id", "base").join(more.select(*key, F.filter("more", lambda s: ~wider(s)).alias("more")), ["k", "h"], "left")
        every = F.concat("base", F.coalesce("more", F.array().cast(SPAN)))
        order = F.array(*map(F.lit, ORDER))
        ranked = F.transform(
            every, lambda s: F.struct(F.array_position(order, s["kind"]).cast("int").alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        )
        spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        out = joined.select(F.col("id").alias(id_col), "base", F.when(F.size("more") > 0, spans).otherwise(F.col("base")).alias("spans"), "h")
        return cut(out)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base spans by kind, a digest of them, all spans as text, and how many of those were learned."""
    found = find_personal_data(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col(id_col).alias("doc_id"),
        *map(count, KINDS),
        F.sha2(F.encode(spelled(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_learned"),
    )


def masked(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[PII]") -> DataFrame:
    """``docs`` with each span of :func:`find_personal_data` (of these docs) replaced by ``mask``.

    Rows are matched by id and text, so ids may repeat or be null; rows keep their number and columns, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    k, h, found = unused(docs, "k", "h", "found")

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(state["at"], s["start"])
        keep = F.substring(text, state["at"] + 1, start - state["at"])
        grown = F.concat(state["out"], F.array(keep, F.when(s["end"] > state["at"], F.lit(mask)).otherwise(F.lit(""))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), grown.alias("out"))

    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    clean = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, rest)
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    own = spans.where(F.size("spans") > 0).select(key(F.col(f"`{id_col}`")).alias(k), F.col("h").alias(h), F.col("spans").alias(found)).dropDuplicates([k, h])
    joined = docs.withColumns({k: key(F.col(f"`{id_col}`")), h: F.xxhash64(text)}).join(own, [k, h], "left")
    columns = (F.when(F.size(found) > 0, clean).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns)
    return joined.select(*columns)
