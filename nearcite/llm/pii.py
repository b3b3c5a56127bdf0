"""Personal data: exact formats, and bootstrapped extraction of further identifiers from their contexts. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import let, row_key, stored

#: The contract's kinds and formats. Possessive quantifiers and the look-behind find the same leftmost
#: matches in linear time and without recursion: a match of these can only begin where a run of its class begins, or
#: where the match before it ended.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a format to match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
#: A token with a digit; what may be an identifier has at least 8 characters, 4 of them digits.
TOKEN = r"(?<![A-Za-z0-9@._%+/-])[A-Za-z@._%+/-]*+[0-9][A-Za-z0-9@._%+/-]*+"
#: Seeds of secrets: long hexadecimal values.
SECRET = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,128}$"
FOUND = "array<struct<s:int,e:int,v:string>>"
#: Code points of the pieces that contexts are cut from: far into a long text, a substring of the whole is slow.
PIECE = 1024
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.8


def scanned(values: Column, empty: Column, add) -> Column:
    """Running results of ``add`` over an array, the first after one element.

    Done within blocks of about the cube root of its size and then over the blocks: an array that grows by one
    element a step is copied each time, which for a text of many matches would take the square of their number.
    """
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))

    def blocked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.cbrt(F.size(v))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.size(v), width)
        return F.transform(starts, lambda at: F.aggregate(F.slice(v, at, width), F.array(empty), grow))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, lambda x: F.element_at(x, -1)), F.array(empty), grow)
        moved = F.zip_with(F.slice(before, 1, F.size(blocks)), blocks, lambda o, x: F.transform(F.slice(x, 2, F.size(x) - 1), lambda y: add(o, y)))
        return F.flatten(moved)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, lambda v: let(blocked(v), joined)))


def _places(text: Column, regex: str) -> Column:
    """Array of (s, e, v): start and end in code points, and text, of all matches from left to right."""

    def laid(gaps: Column, matches: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        ends = scanned(sizes, F.lit(0), lambda total, x: total + x)
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("v")))

    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    none = F.array().cast(FOUND)
    return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, regex), lambda g: laid(g, m))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(x: Column, i: Column) -> Column:
        doubled = x.cast("int") * (1 + i % 2)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    figures = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    return F.aggregate(F.transform(figures, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Struct with an array of (s, e, v) for each kind."""
    return F.struct(*[_spans_of(kind, text).alias(kind) for kind in FORMATS])


def _spans_of(kind: str, text: Column) -> Column:
    passing = F.filter(_places(text, FORMATS[kind]), lambda x: _passes(kind, x["v"]))
    hint = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, passing).otherwise(F.array().cast(FOUND))


def _said(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _described(pieces: Column, start: Column, end: Column, value: Column) -> Column:
    """A place with two words before and one behind."""
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    first, last = (start / PIECE).cast("int"), (end / PIECE).cast("int")
    at = start - F.greatest(first - 1, F.lit(0)) * PIECE
    before = F.substring(F.concat(F.when(first > 0, piece(first - 1)).otherwise(F.lit("")), piece(first)), F.greatest(F.lit(1), at - 63), F.least(at, F.lit(64)))
    behind = F.substring(F.concat(piece(last), piece(last + 1)), end - last * PIECE + 1, F.lit(48))
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    left = lambda b: F.struct(
        flat(F.regexp_extract(b, r"(\S+\s+\S+\s+\S{0,8})$", 1)).alias("left"), flat(F.regexp_extract(b, r"(\S+\s+\S{0,8})$", 1)).alias("last")
    )
    said = lambda x: F.struct(
        start.alias("s"), end.alias("e"), value.alias("v"), x["left"].alias("left"), x["last"].alias("last"),
        flat(F.regexp_extract(behind, r"^(\S{0,8}\s+\S+)", 1)).alias("right"),
    )
    return let(let(before, left), said)


PLACES = "array<struct<s:int,e:int,v:string,left:string,last:string,right:string>>"


def _free(base: Column, found: Column) -> Column:
    """The found places that overlap no base span.

    Spans by start and places by end are laid in one line: a place is free if no span before its end reaches
    beyond its start.
    """
    spans = F.flatten(F.array(*[base[k] for k in FORMATS]))
    ends = F.transform(found, lambda x, i: F.struct(x["e"].alias("at"), F.lit(0).alias("span"), F.lit(0).alias("e"), i.alias("i")))
    starts = F.transform(spans, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("span"), x["e"].alias("e"), F.lit(-1).alias("i")))

    def kept(line: Column) -> Column:
        reach = scanned(F.transform(line, lambda x: x["e"]), F.lit(0), lambda most, e: F.greatest(most, e))
        free = F.filter(
            F.zip_with(line, reach, lambda x, r: F.when((x["span"] == 0) & (r <= F.get(found, x["i"])["s"]), x["i"])), lambda i: i.isNotNull()
        )
        return F.transform(free, lambda i: F.get(found, i))

    return F.when(F.size(spans) == 0, found).otherwise(let(F.array_sort(F.concat(ends, starts)), kept))


def _candidates(base: Column, pieces: Column, text: Column) -> Column:
    """Array of (s, e, v, left, last, right): tokens beside the base spans that may be identifiers, with their contexts."""

    def bare(x: Column) -> Column:
        value = F.regexp_replace(x["v"], r"[._%+/@-]+$", "")
        return let(value, lambda v: F.struct(x["s"].alias("s"), (x["s"] + F.length(v)).alias("e"), v.alias("v")))

    long = F.filter(_places(text, TOKEN), lambda x: (F.length(x["v"]) >= 8) & (F.length(_digits(x["v"])) >= 4))
    free = let(F.transform(long, bare), lambda found: _free(base, found))
    described = F.transform(free, lambda x: _described(pieces, x["s"], x["e"], x["v"]))
    return F.when(text.rlike("[0-9]"), described).otherwise(F.array().cast(PLACES))


def _seeds(base: Column, pieces: Column) -> Column:
    """Struct with the base spans of each kind, of any length and form, described like candidates."""
    return F.struct(*[F.transform(base[k], lambda x: _described(pieces, x["s"], x["e"], x["v"])).alias(k) for k in FORMATS])


def _instances(rows: DataFrame) -> DataFrame:
    """_key, s, e, _value (hash), _seed (kind or null) and _pattern, one row for each context of each base span and candidate."""
    one = rows.select("_key", F.explode("_cand").alias("_c"))
    one = one.select("_key", "_c", F.when(F.col("_c.v").rlike(SECRET), F.lit("secret")).alias("_seed"))
    kinds = lambda k: F.transform(F.col(f"_seeds.{k}"), lambda x: F.struct(x.alias("c"), F.lit(k).alias("k")))
    seeds = F.flatten(F.array(*[kinds(k) for k in FORMATS]))
    own = rows.select("_key", F.explode(seeds).alias("_s")).select("_key", F.col("_s.c").alias("_c"), F.col("_s.k").alias("_seed"))
    one = one.union(own).select(
        "_key", "_c.s", "_c.e", F.xxhash64(F.lower("_c.v")).alias("_value"), "_seed",
        F.array(
            F.when(F.col("_c.left") != "", F.xxhash64(F.lit(1), "_c.left")),
            F.when((F.col("_c.last") != "") & (F.col("_c.right") != ""), F.xxhash64(F.lit(2), "_c.last", "_c.right")),
        ).alias("_patterns"),
    )
    return one.withColumn("_pattern", F.explode_outer(F.array_compact("_patterns"))).drop("_patterns")


def found_spans(rows: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """_key, s, e, kind of the identifiers beside the base: secret seeds, and what good patterns find.

    The graph of patterns and distinct values is scored by turns, for each kind. A pattern's confidence is the mean score of
    its values, with one more that counts nothing; a value's score is the chance that not all of its
    patterns are wrong, 1 for seeds. Patterns need enough different values of the kind that are seeds or were
    accepted in the rounds before. Groups are sums with a
    combine before the shuffle; each turn ends in a written table.
    """
    places = stored(_instances(rows), "pii-instances")
    edges = stored(places.where("_pattern IS NOT NULL").groupBy("_value", "_pattern").agg(F.max("_seed").alias("_seed")), "pii-edges")
    seeds = stored(edges.where("_seed IS NOT NULL").select("_value", F.col("_seed").alias("_kind"), F.lit(1.0).alias("_w")).distinct(), "pii-seeds")
    scores = seeds
    for _ in range(rounds):
        accepted = scores.where(F.col("_w") >= confidence).select("_value", "_kind")
        backed = edges.join(accepted, "_value").groupBy("_pattern", "_kind").agg(F.count("*").alias("_seeds"))
        backed = stored(backed.where(F.col("_seeds") >= support).select("_pattern", "_kind"), "pii-patterns")
        graph = stored(edges.select("_value", "_pattern").join(backed, "_pattern"), "pii-graph")  # values met by patterns of a kind
        weighed = graph.join(scores, ["_value", "_kind"], "left").groupBy("_pattern", "_kind")
        sure = stored(weighed.agg((F.sum(F.coalesce("_w", F.lit(0.0))) / (F.count("*") + 1)).alias("_p")), "pii-confidence")
        missed = F.sum(F.when(F.col("_p") >= 0.5, F.log1p(-F.least(F.col("_p"), F.lit(0.999999)))).otherwise(F.lit(0.0)))
        again = graph.join(sure, ["_pattern", "_kind"]).groupBy("_value", "_kind").agg((1 - F.exp(missed)).alias("_w"))
        scores = stored(again.union(seeds).groupBy("_value", "_kind").agg(F.max("_w").alias("_w")), "pii-scores")
    good = sure.where(F.col("_p") >= confidence).select("_pattern", "_kind")
    likely = scores.where(F.col("_w") >= confidence).select("_value", "_kind")
    met = places.where("_seed IS NULL").join(good, "_pattern").join(likely, ["_value", "_kind"], "left_semi")
    met = met.select("_key", "s", "e", F.when(F.col("_kind") == "secret", F.lit("secret")).otherwise(F.lit("other")).alias("kind"))
    seeds = places.where("_seed = 'secret'").select("_key", "s", "e", F.lit("secret").alias("kind"))
    return met.union(seeds).groupBy("_key", "s", "e").agg(F.max("kind").alias("kind"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _base (spans of each base kind) and _found (array of kind, s, e beside those) of every row.

    One scan of the texts writes spans and candidates; contexts, patterns and scores come from those. Null
    and empty texts hold nothing; rows of equal id and text share what is found; long texts are searched whole;
    an empty table gives no rows; other columns are not read. Spans are in code points, end exclusive.
    """
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = df.select(identity.alias("_id"), row_key(identity, text).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    bare = lambda b: F.struct(*[F.transform(b[k], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in FORMATS])
    parts = lambda b, pieces: F.struct(
        bare(b).alias("base"), _seeds(b, pieces).alias("seeds"), _candidates(b, pieces, F.col("_text")).alias("cand")
    )
    pieces = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    scan = let(base_spans(F.col("_text")), lambda b: let(pieces, lambda p: parts(b, p)))
    rows = rows.select("_id", "_key", scan.alias("_b"))
    rows = stored(rows.select("_id", "_key", F.col("_b.base").alias("_base"), F.col("_b.seeds").alias("_seeds"), F.col("_b.cand").alias("_cand")), "pii-scan")
    found = found_spans(rows).groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("kind", "s", "e"))).alias("_found"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    return rows.join(found, "_key", "left").select("_id", "_base", F.coalesce("_found", none).alias("_found"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = find(df, id_col, text_col)
    base = F.flatten(F.array(*[_said(k, F.col(f"_base.{k}")) for k in FORMATS]))
    # kinds of the method come after the base ones
    secret = _said("secret", F.filter("_found", lambda x: x["kind"] == "secret"))
    other = _said("other", F.filter("_found", lambda x: x["kind"] == "other"))
    return out.select(
        F.col("_id").alias("doc_id"),
        *[F.size(f"_base.{k}").cast("bigint").alias(f"n_{k}") for k in FORMATS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, secret, other), ",").alias("spans"),
    )
