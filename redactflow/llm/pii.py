"""Personal data by patterns and by bootstrapped contexts. DataFrame functions only: no Python runs on the rows.

Base entities (e-mail, ip, card, phone) come from patterns and are the seeds. Every identifier-shaped token (it holds
a digit or an at sign and has at least ``MIN_LENGTH`` characters) that no base span touches is an instance, and so is every
base span as a whole, blanks included; the words in front of it, or the key before its colon or equals sign, are its
lexical pattern. Spark scores the pattern-instance graph: a pattern's
confidence is the share of its distinct instances that are known. Patterns with ``MIN_SUPPORT`` known instances and
``MIN_CONFIDENCE`` make all their instances known, which lets further patterns qualify, until nothing new is found. All
places of a known value that no base span covers become spans of kind ``id``.

All patterns are linear: they start only where a run starts or where the last match ended, and runs are possessive.
Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows are searched each for
itself (a value counts once for a pattern however often it occurs); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.llm.table import boxed, col
from redactflow.session import cut_lineage

MIN_LENGTH = 5
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.9
KINDS = ("email", "ip", "card", "phone", "id")
_WORD = "[A-Za-z0-9._%+-]"
_NOT_BLANK = r"[^\x20\x09-\x0D]"
PATTERNS = {
    "email": rf"(?:(?<!{_WORD})|\G){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign in it.
TOKEN = rf"(?:(?<!{_NOT_BLANK})|\G)[^\x20\x09-\x0D0-9@]*+[0-9@]{_NOT_BLANK}*+"
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    from_right = F.split(F.reverse(digits), "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.filter(from_right, lambda d: d != ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _worth_trying(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][0-9 -]{14}")


def _found(pattern: str, text: Column, trying: Column) -> Column:
    return F.when(trying, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _gaps(pattern: str, text: Column, hits: Column) -> Column:
    """What stands between the matches: one piece more than there are matches."""
    return F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array(text))


def with_hits(df: DataFrame, text: Column, patterns: dict[str, str], tries: dict[str, Column]) -> DataFrame:
    """Adds ``h_<name>`` (matches) and ``g_<name>`` (pieces between) for each pattern."""
    df = df.withColumns({f"h_{k}": _found(p, text, tries[k]) for k, p in patterns.items()})
    return df.withColumns({f"g_{k}": _gaps(p, text, F.col(f"h_{k}")) for k, p in patterns.items()})


def _key_and_value(hit: Column, before: Column) -> tuple[Column, Column, Column]:
    """(lexical pattern, value, characters in front of the value) of a token. ``before`` is the text in front of it.

    ``key=value`` and ``key:value`` give the key as the pattern, other tokens the two words before, lower-cased and
    with digits as 0. Signs around the value are not part of it.
    """
    key = F.regexp_extract(hit, "^[^=:]++[=:](?=.)", 0)
    words = F.filter(F.split(before, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    two = F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " "))
    bare = F.substring(hit, F.length(key) + 1, F.length(hit))
    sign = F.regexp_extract(bare, "^[^A-Za-z0-9+@]*+", 0)
    value = F.regexp_replace(F.substring(bare, F.length(sign) + 1, F.length(bare)), "(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    pattern = F.regexp_replace(F.lower(F.when(key != "", key).otherwise(two)), "[0-9]", "0")
    return pattern, value, F.length(key) + F.length(sign)


def _pattern_before(before: Column) -> Column:
    """The lexical pattern of a base span, the same that a token starting with it has: the key that adjoins it, signs
    between them left out, or else the two words before. Signs alone in front of the span are no word."""
    run = F.regexp_extract(before, rf"(?<!{_NOT_BLANK}){_NOT_BLANK}++$", 0)
    signs = r"(?<![^A-Za-z0-9+@=:])[^A-Za-z0-9+@=:]++$"
    first = F.regexp_extract(run, "^([^=:]++[=:])[^A-Za-z0-9+@]*+$", 1)
    last = F.regexp_extract(F.regexp_replace(run, signs, ""), r"(?<=[=:])([^=:]++[=:])[=:]*+$", 1)
    key = F.when(first != "", first).otherwise(last)
    rest = F.when(run.rlike("[A-Za-z0-9+@]"), before).otherwise(F.substring(before, F.lit(1), F.length(before) - F.length(run)))
    words = F.filter(F.split(rest, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    two = F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " "))
    return F.regexp_replace(F.lower(F.when(key != "", key).otherwise(two)), "[0-9]", "0")


def _pieces(kind: str) -> Column:
    """Each match with its pattern, taken from the text from two matches before on."""
    hits, gaps = F.col(f"h_{kind}"), F.col(f"g_{kind}")
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))

    def piece(p: Column, i: Column) -> Column:
        back = lambda n, a: F.coalesce(F.get(a, i - n), F.lit(""))
        before = F.concat(back(2, hits), back(1, gaps), back(1, hits), p["g"])
        if kind == "token":
            pattern, value, skipped = _key_and_value(p["h"], before)
        else:
            pattern, value, skipped = _pattern_before(F.concat(back(2, gaps), before)), p["h"], F.lit(0)
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(p["g"]).cast("bigint").alias("gap"),
            F.length(p["h"]).cast("bigint").alias("n"),
            skipped.cast("bigint").alias("skipped"),
            pattern.alias("pattern"),
            value.alias("value"),
        )

    return F.transform(pairs, piece)


def _tries(text: Column) -> dict[str, Column]:
    tries = {k: _worth_trying(k, text) for k in PATTERNS}
    return tries | {"token": text.rlike("[0-9@]")}


def places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, entities): rows has _row, doc_id, text_key for every input row; entities has _row, kind, start, end,
    value and pattern. Both are written once."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("text_key"), body.alias("text"))
    patterns = PATTERNS | {"token": TOKEN}
    hit = with_hits(rows, F.col("text"), patterns, _tries(F.col("text")))
    found = hit.select("doc_id", "text_key", F.flatten(F.array(*[_pieces(k) for k in patterns])).alias("pieces"))
    found = cut_lineage(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    each = found.select("_row", F.explode("pieces").alias("p")).select("_row", "p.*")
    # the window holds the matches of one kind in one text
    upto = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    placed = each.withColumn("start", end - F.col("n") + F.col("skipped"))
    entities = placed.select("_row", "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value", "pattern")
    keep = F.lit(False)
    for kind in PATTERNS:
        keep = keep | ((F.col("kind") == kind) & _valid(kind, F.col("value")))
    keep = keep | ((F.col("kind") == "token") & (F.length("value") >= MIN_LENGTH) & F.col("value").rlike("[0-9@]"))
    return found.select("_row", "doc_id", "text_key"), cut_lineage(entities.filter(keep), "entities")


def _instances(entities: DataFrame) -> DataFrame:
    """Base spans with ``known`` 1, and the tokens that no base span touches with ``known`` 0."""
    spans = entities.filter("kind <> 'token'")
    base = spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    tokens = entities.filter("kind = 'token'").join(base, "_row", "left")
    held = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    touched = F.exists(held, lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    names = ["_row", "start", "end", "value", "pattern"]
    seeds = spans.select(*names, F.lit(1).alias("known"))
    return seeds.unionByName(tokens.filter(~touched).select(*names, F.lit(0).alias("known")))


def bootstrap(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, values): accepted patterns with their scores, and known values with ``seed`` (found by a base
    pattern). The graph holds distinct (pattern, value) pairs, aggregated before the shuffle."""
    graph = instances.filter(F.col("pattern").rlike("[^0 ]")).select("pattern", "value").distinct()
    graph = cut_lineage(graph, "graph")
    known = cut_lineage(instances.filter("known = 1").select("value").distinct().withColumn("seed", F.lit(True)), "known")
    while True:
        scored = (
            graph.join(known.select("value", F.lit(1).alias("k")), "value", "left")
            .groupBy("pattern")
            .agg(F.count("k").alias("n_known"), F.count("*").alias("n"))
            .withColumn("confidence", F.col("n_known") / F.col("n"))
        )
        good = scored.filter((F.col("n_known") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        new = graph.join(good.select("pattern"), "pattern", "left_semi").select("value").distinct()
        new = cut_lineage(new.join(known, "value", "left_anti").withColumn("seed", F.lit(False)), "found")
        if new.isEmpty():
            return good, known
        known = cut_lineage(known.unionByName(new), "known")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, base and extra: arrays of (rank of kind, start, end, kind, value)."""
    rows, entities = places(docs, doc_id, text)
    instances = cut_lineage(_instances(entities), "instances")
    _, known = bootstrap(instances)
    more = instances.filter("known = 0").join(known, "value", "left_semi").select("_row", F.lit("id").alias("kind"), "start", "end", "value")
    spans = entities.filter("kind <> 'token'").select("_row", "kind", "start", "end", "value").unionByName(more)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct(rank.alias("rank"), "start", "end", "kind", "value")
    per_row = spans.groupBy("_row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return rows.join(per_row, "_row", "left").select(
        "doc_id", "text_key", F.filter("spans", lambda s: s["kind"] != "id").alias("base"), F.filter("spans", lambda s: s["kind"] == "id").alias("extra")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas; empty for none."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def count_of(kind: str, spans: Column) -> Column:
    return F.coalesce(F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint"), F.lit(0).cast("bigint"))


def _joiner(put: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(put(hit)))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, in the order of KINDS."""
    found = personal_data(docs)
    extra = (
        found.filter(F.size("extra") > 0)
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.explode("extra").alias("s"))
        .groupBy("_id", "_key")
        .agg(F.collect_set("s.value").alias("_extra"))
    )
    extra = cut_lineage(extra, "extra")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    out = boxed(docs, doc_id=F.col("doc_id").cast("bigint"), text_key=F.xxhash64("text"), text=F.col("text"))
    out = out.join(extra, same, "left").withColumn("_masked", F.coalesce("text", F.lit("")))
    for kind, pattern in ({"token": TOKEN} | PATTERNS).items():
        # values of the method first: their tokens are still whole
        text = F.col("_masked")
        trying = F.col("_extra").isNotNull() if kind == "token" else _worth_trying(kind, text)
        out = with_hits(out, text, {kind: pattern}, {kind: trying})
        hits, gaps = F.col(f"h_{kind}"), F.col(f"g_{kind}")
        if kind == "token":

            def put(h: Column) -> Column:
                _, value, skipped = _key_and_value(h, F.lit(""))
                whole = F.concat(F.substring(h, 1, skipped), F.lit("[ID]"), F.substring(h, skipped + F.length(value) + 1, F.length(h)))
                return F.when(F.array_contains("_extra", value), whole).otherwise(h)
        else:

            def put(h: Column, kind: str = kind) -> Column:
                return F.when(_valid(kind, h), F.lit(f"[{kind.upper()}]")).otherwise(h)

        pieces = F.zip_with(gaps, hits, _joiner(put))
        out = out.withColumn("_masked", F.when(F.size(hits) > 0, F.array_join(pieces, "")).otherwise(text))
        out = out.drop(f"h_{kind}", f"g_{kind}")
    masked = F.when(F.col("text").isNotNull(), F.col("_masked")).alias("text")
    return out.select(*[masked if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
