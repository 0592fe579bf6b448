r"""Personal data by information-theoretic sanitisation, in DataFrame functions only.

Protected entities are what the base spans (email, ip, card, phone), found by patterns in every whole text, name: the
value itself, compared without case and signs between digits, and what several values have in common, the domain of an
address, the first three and two numbers of an ip, the issuer (six digits) of a card, the first six digits of a phone
number, unless more than `widest` of all texts have that in common, which then tells nobody apart. What else would
reveal them is estimated from the corpus: terms (runs of letters) in a text, outside its entities, co-occur with the
entities in it, and a term t discloses an entity c as

    PMI(c; t) / IC(c) = log(n(c, t) N / (n(c) n(t))) / log(N / n(c)),

with N the number of distinct texts, n(c), n(t) the numbers that hold c or t, and n(c, t) those where they co-occur. The
ratio is 1 where every text with t has c. Terms at `threshold` or above are sanitised if the evidence is enough: for a
value, `support` texts or more, or two where chance makes no such pair; for what values share, which is common, only
where chance makes no such pair. With f = n(c, t) / n(t) and p = n(c) / N, an independent term meets an entity so often
with a probability of at most exp(-n(t) KL(f, p)), and the number of such pairs expected among all entities and terms
must be at most `chance`. Every occurrence in every text becomes a span of kind `term`. Base spans stay as they are; a term inside one adds nothing.
`sanitise` generalises a base span to its kind's name in angle brackets and a term to `<TERM>`, or removes both.

Candidates are pruned before the corpus count of terms: n(t) is at least the number of texts where t stands with any
entity, which bounds the ratio from above. Texts are counted once for each distinct text (128-bit key), so copies add
no evidence and a text that a third of the rows share is no hot group: counts are partial aggregates.

Patterns are the given ones in possessive form with a guard in front, which match the same and never backtrack: the
guard allows a match to start only where a run of its first class starts, or where the last match ended.

Defined results: a null text is empty and has no spans; repeated rows are judged alike; an empty table gives an empty
result; a corpus of one text has no term (its IC is zero); a term that discloses several entities is one term; a very
long text is one row, with its spans and distinct words in arrays; further columns, whatever their names, aren't read,
and `sanitise` leaves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimodel.llm.common import discard, free, sieved, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}+"
#: A cheap test that a text can hold the kind at all.
MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda m: _valid(kind, m["value"])


def _entry(number: int, value: bool) -> Callable[[Column], Column]:
    """A span as (start, kind, end), or as (kind, value, start, end)."""
    kind = F.lit(number).alias("kind")
    if value:
        return lambda s: F.struct(kind, s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"))
    return lambda s: F.struct(s["start"].alias("start"), kind, s["end"].alias("end"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once. A column that a lambda names is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(lengths: Column, add: Callable[[Column, Column], Column] = lambda a, v: a + v) -> Column:
    """The sum (or what add makes) of all lengths before each element, in blocks of about the root of their number: no
    step is quadratic. lengths: a bound variable."""
    n = F.size(lengths)
    fold = lambda x: F.aggregate(x, F.lit(0), add)

    def of_blocks(block: Column) -> Column:
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        per_block = F.transform(blocks, lambda b: fold(F.slice(lengths, b * block + 1, block)))
        before = lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums)), lambda b: fold(F.slice(sums, F.lit(1), b)))
        return _let(per_block, lambda sums: _let(before(sums), lambda total: F.flatten(F.transform(blocks, lambda b: inside(block, b, F.element_at(total, (b + 1).cast("int")))))))

    def inside(block: Column, b: Column, start: Column) -> Column:
        part = lambda own: F.transform(own, lambda _, i: add(start, fold(F.slice(own, F.lit(1), i))))
        return _let(F.slice(lengths, b * block + 1, block), part)

    return _let(F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int"), of_blocks)


def _located(text: Column, pattern: str | Column) -> Column:
    """Matches as an array of (start, end, value), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m))
        return _let(sizes, lambda n: F.zip_with(F.zip_with(_starts(n), n, lambda s, k: s + k), x["found"], lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))))

    return _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


NOTHING = "array<struct<start:int,end:int,value:string>>"


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's spans that hold."""
    return {
        kind: F.when(MAY[kind](text), F.filter(_located(text, PATTERNS[kind]), _test(kind))).otherwise(F.array().cast(NOTHING))
        for kind in KINDS
    }


def _keyed(docs: DataFrame, text_col: str, names: list[str] | None = None) -> DataFrame:
    """docs with tm_text (never null) and the text's key tm_k1, tm_k2, or with other names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    value, k1, k2 = names or ("tm_text", "tm_k1", "tm_k2")
    return docs.select("*", text.alias(value), F.xxhash64(text).alias(k1), F.xxhash64(F.lit(7), text).alias(k2))


def _shown(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"]), s["start"], s["end"])), ",")


def _numbered(row: DataFrame) -> Column:
    """All base spans of a row as (start, kind number, end)."""
    return F.concat(*[F.transform(F.col(f"tm_{kind}"), _entry(k + 1, False)) for k, kind in enumerate(KINDS)])


def _replaced(text: Column, spans: Column, name: Callable[[Column], Column]) -> Column:
    """The text with a name for each span (start, kind, end; sorted). A span's name follows what lies between it and all
    spans before; a span inside an earlier one adds nothing."""

    def of(x: Column) -> Column:
        piece = lambda s, r: F.when(s["start"] >= r, F.concat(F.substring(text, r + 1, s["start"] - r), name(s))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.zip_with(spans, x["reached"], piece), ""), F.substring(text, F.array_max(x["ends"]) + 1, F.length(text)))

    return _let(F.transform(spans, lambda s: s["end"]), lambda ends: _let(F.struct(_starts(ends, lambda a, v: F.greatest(a, v)).alias("reached"), ends.alias("ends")), of))


def found_spans(docs: DataFrame, text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """A written table: the columns `also`, the text's key and the base spans of each row."""
    keyed = _keyed(docs, text_col)
    spans = base_spans(F.col("tm_text"))
    return written(keyed.select(*[F.col(c) for c in also], "tm_k1", "tm_k2", *[spans[k].alias(f"tm_{k}") for k in KINDS]))


def _levels(c: Column) -> Column:
    """Hashes of the entities that a base span (kind, value) names: even for the value itself, odd for what it shares."""
    digits = F.regexp_replace(c["value"], "[^0-9]", "")
    level = lambda name, value: F.shiftleft(F.xxhash64(F.lit(name), c["kind"], value), 1) + F.lit(int(name != "value"))
    whole = F.when(c["kind"] > 2, digits).otherwise(F.lower(c["value"]))
    common = F.when(c["kind"] == 1, F.array(level("domain", F.lower(F.substring_index(c["value"], "@", -1)))))
    common = common.when(c["kind"] == 2, F.array(level("net", F.substring_index(c["value"], ".", 3)), level("net", F.substring_index(c["value"], ".", 2))))
    return F.concat(F.array(level("value", whole)), common.otherwise(F.array(level("prefix", F.substring(digits, 1, 6)))))


def _beyond_chance(n_ct: Column, n_c: Column, n_t: Column, total: float, tests: Column, chance: float) -> Column:
    """Whether at most `chance` of `tests` independent pairs would meet so often, by the Chernoff bound."""
    f, p = n_ct / n_t, n_c / F.lit(total)
    apart = F.when(f >= 1, -F.log(p)).otherwise(f * F.log(f / p) + (1 - f) * F.log((1 - f) / (1 - p)))
    return (f > p) & (n_t * apart >= F.log(tests / chance))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = 3, threshold: float = 0.95, chance: float = 0.05, widest: float = 0.1) -> DataFrame:
    """A written table (tm_k1, tm_k2, term): for texts by key, the terms in them whose disclosure is at the threshold."""
    keyed = _keyed(docs, text_col)
    spans = base_spans(F.col("tm_text"))
    entity = F.concat(*[F.transform(spans[kind], _entry(k + 1, True)) for k, kind in enumerate(KINDS)])
    near = keyed.where(MAY["email"](F.col("tm_text")) | MAY["phone"](F.col("tm_text")) | MAY["ip"](F.col("tm_text")) | MAY["card"](F.col("tm_text")))
    near = near.select("tm_k1", "tm_k2", "tm_text", entity.alias("c")).where(F.size("c") > 0)
    # What stands in the text besides entities.
    places = F.array_sort(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    rest = _replaced(F.col("tm_text"), places, lambda s: F.lit(" "))
    named = F.array_distinct(F.flatten(F.transform("c", _levels)))
    near = written(near.select("tm_k1", "tm_k2", named.alias("cs"), F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(TERM), F.lit(0))).alias("terms")).dropDuplicates(["tm_k1", "tm_k2"]))
    mentions = near.select("tm_k1", "tm_k2", F.explode("cs").alias("c"))
    beside = near.select("tm_k1", "tm_k2", F.explode("terms").alias("term"))
    # One text discloses nothing, so entities and terms of one text have no pair that counts.
    total = found.select("tm_k1", "tm_k2").distinct().count()
    own = F.col("c").bitwiseAND(F.lit(1)) == 0
    entities = written(mentions.groupBy("c").agg(F.count(F.lit(1)).alias("n_c")).where((F.col("n_c") > 1) & (own | (F.col("n_c") <= widest * total))))
    seen = written(beside.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    at_least = seen.where("n_t > 1")
    values, all_, n_terms = entities.where(own).count(), entities.count(), seen.count()
    tests = F.when(own, F.lit(float(max(values * n_terms, 1)))).otherwise(F.lit(float(max((all_ - values) * n_terms, 1))))
    ratio = F.log(F.col("n_ct") * F.lit(float(total)) / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_c"))
    enough = (F.col("n_c") < total) & (F.col("n_ct") > 1) & (ratio >= threshold)
    # Two independent entries meet twice or more with this probability at most, which is closer than Chernoff's for two.
    twice = F.col("n_c") * (F.col("n_c") - 1) * F.col("n_t") * (F.col("n_t") - 1) / F.lit(max(2.0 * total * (total - 1), 1.0))
    enough &= (own & ((F.col("n_ct") >= support) | (twice * tests <= chance))) | _beyond_chance(F.col("n_ct"), F.col("n_c"), F.col("n_t"), float(total), tests, chance)
    # A term in too many texts for the commonest entity is none for any: the ratio is at most that of n_ct = n_c.
    top = entities.agg(F.max("n_c")).first()[0] or 0
    usable = written(at_least.where(F.col("n_t") <= F.lit(1.001 * top ** threshold * max(total, 1) ** (1 - threshold))))
    pairs = mentions.join(entities, "c", "left_semi").join(beside.join(usable, "term", "left_semi"), ["tm_k1", "tm_k2"])
    together = written(pairs.groupBy("c", "term").agg(F.count(F.lit(1)).alias("n_ct")).where("n_ct > 1"))
    candidates = written(together.join(entities, "c").join(usable, "term").where(enough).select("c", "term", "n_ct", "n_c"))
    terms = written(candidates.select("term").distinct())
    words = keyed.select("tm_k1", "tm_k2", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("tm_text"), F.lit(TERM), F.lit(0)))).alias("term"))
    holding = written(words.join(terms, "term", "left_semi").distinct())
    n_t = written(holding.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    sure = written(candidates.join(n_t, "term").where(enough).select("term").distinct())
    out = written(holding.join(sure, "term", "left_semi"))
    discard(docs.sparkSession, near, entities, seen, usable, together, candidates, terms, holding, n_t, sure)
    return out


def _with_terms(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(tm_k1, tm_k2, tm_terms): places of the terms of each distinct text that has some."""
    of_text = written(terms.groupBy("tm_k1", "tm_k2").agg(F.collect_set("term").alias("terms")))
    rows = _keyed(docs, text_col).select("tm_k1", "tm_k2", "tm_text").join(of_text, ["tm_k1", "tm_k2"])
    any_of = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?!\p{L})"))
    places = F.transform(_located(F.col("tm_text"), any_of), _entry(len(KINDS) + 1, False))
    return written(rows.select("tm_k1", "tm_k2", places.alias("tm_terms")).distinct())


def _outside(terms: Column, base: Column) -> Column:
    """Terms that don't touch a base span."""
    return _let(base, lambda spans: F.filter(terms, lambda t: ~F.exists(spans, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **method: float) -> DataFrame:
    """id, tm_email, tm_ip, tm_card, tm_phone (base spans: start, end, value), tm_base and tm_terms (start, kind, end)."""
    found = found_spans(docs.select(id_col, text_col), text_col, (id_col,))
    only = docs.select(text_col)
    places = _with_terms(only, disclosing_terms(only, found, text_col, **method), text_col)
    base = found.withColumn("tm_base", _numbered(found))
    return base.join(places, ["tm_k1", "tm_k2"], "left").withColumn("tm_terms", F.when(F.col("tm_terms").isNull(), F.array().cast("array<struct<start:int,kind:int,end:int>>")).otherwise(_outside(F.col("tm_terms"), F.col("tm_base"))))


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [F.size(f"tm_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(_shown(F.col("tm_base")), 256).alias("base_sha256"), _shown(F.concat("tm_base", "tm_terms")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", remove: bool = False, **method: float) -> DataFrame:
    """docs, same columns, with every span generalised (or removed). Overlapping spans become one, named by the first."""
    only = docs.select(text_col)
    each = found_spans(only, text_col)
    found = written(each.distinct())
    discard(docs.sparkSession, each)
    base = found.select("tm_k1", "tm_k2", _numbered(found).alias("tm_base"))
    terms = disclosing_terms(only, found, text_col, **method)
    places = _with_terms(only, terms, text_col)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    both = base.join(places, ["tm_k1", "tm_k2"], "left").select("tm_k1", "tm_k2", F.array_sort(F.concat("tm_base", F.coalesce("tm_terms", none))).alias("tm_spans"))
    both = written(both.where(F.size("tm_spans") > 0))
    discard(docs.sparkSession, found, terms, places)
    text, k1, k2, own1, own2, places_ = free(docs, "tm_text", "tm_k1", "tm_k2", "tm_own1", "tm_own2", "tm_spans")
    both = both.select(F.col("tm_k1").alias(own1), F.col("tm_k2").alias(own2), F.col("tm_spans").alias(places_))
    # A text without a span is moved nowhere, however many have one.
    rows, rest = sieved(_keyed(docs, text_col, [text, k1, k2]), [k1, k2], both.select(own1, own2))
    rows = rows.join(both, (F.col(k1) == F.col(own1)) & (F.col(k2) == F.col(own2)), "left")
    names = F.array(*[F.lit("" if remove else f"<{k.upper()}>") for k in (*KINDS, "term")])
    clean = _replaced(F.col(text), F.col(places_), lambda s: F.element_at(names, s["kind"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*columns).unionByName(rows.withColumn(text_col, F.when(F.col(places_).isNull(), F.col(text_col)).otherwise(clean)).select(*columns))
